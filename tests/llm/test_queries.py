"""The registered queries on a small folder of tables, by the columns that their contracts name, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from panelgauge.llm import queries as Q
from panelgauge.llm import quality

from test_exact import DOCS, WORDS, brute_bytes, brute_classes, brute_runs, ids_of


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents with nulls, ties in source and copies; labels, pages, embeddings."""
    path = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(12)
    documents = [(i, t, "en", [None, "a", "b", "ö", "C"][i % 5 if i % 9 else 1], len(t or "")) for i, t in DOCS]
    labels = [(i, int(i % 3 > 0), 0) for i, _ in DOCS[::2]]
    body = lambda n: f"<article><h1>T {n}</h1><p>{' '.join(rng.choice(WORDS) for _ in range(30))}</p></article>"
    pages = [(i, f"http://h{i % 3}.example/{i}", f"<html><body><nav>menu</nav>{body(i % 11)}<footer>f</footer></body></html>") for i in range(40)]
    pages += [(100, "http://h0.example/c", pages[0][2]), (101, None, None), (102, "http://z", "short"), (103, "http://z", "short")]
    vec = np.random.default_rng(3).normal(size=(12, 8))
    embeddings = [(i, [float(x) for x in vec[i % 12] + (i // 12) * 0.01], 0) for i in range(40)] + [(50, None, 0), (51, [0.0] * 8, 0), (52, [float("nan")] * 8, 0)]
    for name, rows, ddl in (("documents", documents, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("pages", pages, "page_id long, url string, html string"), ("embeddings", embeddings, "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame(rows, ddl).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path, documents, pages, embeddings


@pytest.fixture(scope="module")
def duck(tables):
    c = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0]}/{t}.parquet/*.parquet'")
    return c


def run(spark, tables, name, key="doc_id"):
    return {r[key]: r for r in Q.queries()[name](spark, tables[0]).collect()}


def same_as_sql(duck, got, name):
    want = duck.sql(Q.oracle_sql()[name]).fetchall()
    cols = [c[0] for c in duck.sql(Q.oracle_sql()[name]).description]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted((str(tuple(plain(r[c]) for c in cols)) for r in got.values())) == sorted(str(tuple(map(plain, r))) for r in want)


def test_op1(spark, tables, duck):
    got = run(spark, tables, "op1_suffix_dedup")
    for i, (n, kept, spans) in brute_bytes(DOCS).items():
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (n, n - len(kept), spans, hashlib.sha256(kept).hexdigest())
    same_as_sql(duck, got, "op1_suffix_dedup")


def test_op2(spark, tables, duck):
    got = run(spark, tables, "op2_jaccard_join")
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_classes(DOCS, 3, 90)
    same_as_sql(duck, got, "op2_jaccard_join")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_op3(spark, tables):
    got = run(spark, tables, "op3_quality")
    assert len(got) == len(DOCS)
    for i, t in DOCS:
        w, r = words(t), got[i]
        windows = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        repeat = len({k for j in range(len(w) - 7) if windows[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)})
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeat)
        assert r["base_failed"] == (len(w) < 20 or 100 * repeat > 30 * len(w)) and (not r["kept"] or not r["base_failed"])


def test_op3_scores_are_the_ratios_of_whole_counts(spark, tables):
    """Score and verdict from counts that a plain loop over all texts makes."""
    labelled = {i: int(i % 3 > 0) for i, _ in DOCS[::2]}
    raw, target = np.zeros(1 << quality.BINS_LOG2), np.zeros(1 << quality.BINS_LOG2)
    bins = {i: quality.gram_bins((t or "").encode()) for i, t in DOCS}
    for i, b in bins.items():
        np.add.at(raw, b, 1)
        if labelled.get(i) == 1:
            np.add.at(target, b, 1)
    prior = (raw + 0.2) / (raw.sum() + 0.2 * len(raw))
    strength = 0.2 * len(raw)
    ratios = np.log((target + strength * prior) / (target.sum() + strength) / prior)
    got = run(spark, tables, "op3_quality")
    for i, b in bins.items():
        assert got[i]["score"] == pytest.approx(ratios[b].mean() if len(b) else 0.0, abs=1e-5)
    keep = [r["score"] for r in got.values() if r["kept"]]
    drop = [r["score"] for r in got.values() if not r["kept"] and not r["base_failed"]]
    assert not drop or not keep or max(drop) < min(keep)


def test_op4(spark, tables, duck):
    got = run(spark, tables, "op4_mixing")
    size = {i: len(words(t)) for i, t in DOCS}
    source = {i: s for i, _, _, s, _ in tables[1]}
    total, taken = collections.Counter(), collections.Counter()
    for i, r in got.items():
        assert r["size"] == size[i] and 0 <= r["taken"] <= 2 * size[i]
        total[source[i]] += size[i]
        taken[source[i]] += r["taken"]
    target = {source[i]: r["target"] for i, r in got.items()}
    assert all(r["source_size"] == total[source[i]] for i, r in got.items()) and all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert sum(target.values()) == pytest.approx(1.5 * sum(total.values())) and all(t <= 2 * total[s] + 1e-9 for s, t in target.items())
    same_as_sql(duck, got, "op4_mixing")


def test_op5(spark, tables):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in Q.queries()["op5_packing"](spark, tables[0]).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in DOCS:
        ids, at = [*ids_of(t), 1], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes()))
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_op6(spark, tables):
    got, start = run(spark, tables, "op6_token_store"), 0
    for i, t in sorted(DOCS):
        ids = [*ids_of(t), 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op7(spark, tables):
    got = run(spark, tables, "op7_html_extract", "page_id")
    for i, url, html in tables[2]:
        m = re.search(r"<h1>(.*?)</h1><p>(.*?)</p>", html or "")
        want = f"{m[1]}\n{m[2]}" if m else html or ""
        assert (got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (url, want, len(want))


def test_op8(spark, tables, duck):
    got = run(spark, tables, "op8_embedding_dedup", "vec_id")
    same_as_sql(duck, got, "op8_embedding_dedup")
    assert [(got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in (50, 51, 52)] == [(0, i, True) for i in (50, 51, 52)]


def test_op9(spark, tables, duck):
    got = run(spark, tables, "op9_warc", "page_id")
    first = {}
    for i, _, html in sorted(tables[2], key=lambda p: p[0]):
        body = (html or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        again = len(body) >= 100 and digest in first
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == (len(body), digest, "revisit" if again else "response", first[digest] if again else None)
        first.setdefault(digest, i)
    same_as_sql(duck, got, "op9_warc")


def test_op10(spark, tables, duck):
    got = run(spark, tables, "op10_line_dedup")
    seqs, runs = brute_runs(DOCS)
    for i, t in DOCS:
        gone = {seqs[i][q][0] for a, b in runs[i] for q in range(a, b)}
        lines = (t or "").split("\n")
        kept = "\n".join(x for p, x in enumerate(lines) if p not in gone)
        assert (got[i]["n_lines"], got[i]["n_removed"], got[i]["n_runs"], got[i]["kept_md5"]) == (len(lines), len(gone), len(runs[i]), hashlib.md5(kept.encode()).hexdigest())
    same_as_sql(duck, got, "op10_line_dedup")
