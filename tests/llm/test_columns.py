"""Every operator and pipeline stage on tables whose extra columns have the names that the operators use inside: no crash, values unchanged."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from panelgauge.llm import embedding_dedup, html_extract, jaccard_join, line_dedup, mixing, packing, quality, suffix_dedup, token_store, warc

CLASH = (
    "size draw slice part pattern taken whole edge before row_key kept __id __hash __text_hash __quality __doc __lines __runs __kept row text_hash rep n token tokens hist lines runs q pos rank first last k ids digest "
    "digests seq start place root host html2 content menus own payload header record_type refers unit keys class_id a.b b`c"
).split()
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo".split()
TEXTS = [" ".join(WORDS[i % 5 :] + WORDS[: i % 7] + [f"w{i}"]) + "\n" + " ".join(WORDS[::-1]) + "\n" + f"line {i % 3}" for i in range(12)] + [None, "", "x"]


def with_clash(df):
    return df.withColumns({c.replace("`", ""): F.concat(F.lit(f"{c} "), F.col(df.columns[0]).cast("string")) for c in CLASH if c not in df.columns})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "abc"[i % 3], "en", len(t or "")) for i, t in enumerate(TEXTS)]
    return with_clash(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")).cache()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def unchanged(before, after, changed=()):
    """Every row that is left has the values of a row of its id."""
    assert after.columns == before.columns
    free = [f"`{c}`" for c in before.columns if c not in changed]
    known = collections.Counter(map(tuple, before.select(*free).collect()))
    left = collections.Counter(map(tuple, after.select(*free).collect()))
    assert left and set(left) <= set(known)


def test_quality_stage(spark, docs, sf_dir):
    unchanged(docs, P.quality_rules(spark, docs, sf_dir))


def test_line_stage(spark, docs, sf_dir):
    out = P.line_dedup(spark, docs, sf_dir)
    unchanged(docs, out, ("text", "n_chars"))
    assert out.count() == len(TEXTS)


def test_jaccard_stage(spark, docs, sf_dir):
    unchanged(docs, P.near_duplicates(spark, docs, sf_dir))


def test_mixing_stage(spark, docs, sf_dir):
    unchanged(docs, P.source_mixing(spark, docs, sf_dir))


def test_packing_stage(spark, docs, sf_dir):
    assert P.packing(spark, docs, sf_dir).select("doc_id").distinct().count() == len(TEXTS)


def test_document_operators(spark, docs, tmp_path):
    plain = docs.select("doc_id", "text", "source")
    same = lambda f, *by: sorted(map(str, f(docs).select(*by).collect())) == sorted(map(str, f(plain).select(*by).collect()))
    assert same(suffix_dedup.remove_repeats, "doc_id", "starts", "ends")
    assert same(lambda d: jaccard_join.jaccard_classes(d, 3, 60), "doc_id", "n_shingles", "component_id")
    assert same(line_dedup.drop_repeated_lines, "doc_id", "text")
    assert same(lambda d: mixing.mix_sources(d, F.array("source"))[0], "doc_id", "size", "taken")
    assert same(lambda d: quality.score_documents(d, quality.fit(d, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).ratios), "row.doc_id", "quality.score")
    assert same(lambda d: packing.pack(d, 64), "doc_id", "start", "ids_crc32") or packing.pack(docs, 64).agg(F.sum("length")).first() == packing.pack(plain, 64).agg(F.sum("length")).first()
    for name, d in (("a", docs), ("b", plain)):
        token_store.write_store(d, f"file://{tmp_path}/{name}")
    a, b = (sorted(map(tuple, token_store.verify_store(spark, f"file://{tmp_path}/{x}").collect())) for x in "ab")
    assert a == b


def test_page_and_vector_operators(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<article><h1>T {i}</h1><p>text {i % 3}</p></article>") for i in range(9)], "page_id long, url string, html string")
    wide = with_clash(pages)
    assert sorted(map(tuple, html_extract.extract(wide).collect())) == sorted(map(tuple, html_extract.extract(pages).collect()))
    warc.write_archive(wide, f"file://{tmp_path}/w")
    assert warc.measured(warc.read_archive(spark, f"file://{tmp_path}/w")).count() == 9
    vectors = spark.createDataFrame([(i, [1.0, i % 4 / 10, 0.0, 2.0]) for i in range(12)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(with_clash(vectors)).collect())) == sorted(map(tuple, embedding_dedup.near_duplicates(vectors).collect()))


def test_dotted_key_columns(spark):
    d = spark.createDataFrame([(1, "a b c d", "x"), (2, "a b c d", "x")], "`id.x` long, `text.x` string, source string")
    assert jaccard_join.drop_near_duplicates(d, 3, 90, "id.x", "text.x").columns == d.columns
    assert line_dedup.drop_repeated_lines(d, 1, 50, "id.x", "text.x").select("`text.x`").collect()[0][0] in ("a b c d", "")
    assert mixing.take_copies(d, F.array("source"), "id.x", "text.x").columns == d.columns
    assert packing.pack(d, id_col="id.x", text_col="text.x").count() >= 2
    assert suffix_dedup.remove_repeats(d, id_col="id.x", text_col="text.x").count() == 2
