"""Exact operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, extra columns."""

import collections
import hashlib
import random
import re
import shutil
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelgauge.llm import embedding_dedup, html_extract, jaccard_join, line_dedup, mixing, packing, quality, suffix_dedup, token_store, tokens, warc
from panelgauge.llm.common import tidy

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau Upsilon phi, chi. psi! omega été Straße 12".split()


def make_docs(seed=1, n=60):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    passage = [say(30), say(60)]
    docs = []
    for i in range(n):
        kind = i % 10
        if kind == 0 and docs:
            text = rng.choice(docs)[1]
        elif kind == 1 and docs:
            w = (rng.choice(docs)[1] or "a b").split(" ")
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 2:
            text = say(20) + "\n" + passage[i % 2] + "\n" + say(10)
        elif kind == 3:
            text = "\n".join([say(3)] * 4 + [say(5)])
        else:
            text = "\n".join(say(rng.randrange(1, 40)) for _ in range(rng.randrange(1, 6)))
        docs.append((i, text))
    docs += [(n, None), (n + 1, ""), (n + 2, " \n \t"), (n + 3, "one two"), (n + 4, "aaaa " * 4000), (n + 5, "aaaa " * 3000), (n + 6, "one two")]
    return docs


DOCS = make_docs()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, i % 3, "x") for i, t in DOCS], "doc_id long, text string, n long, token string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ------------------------------------------------- suffix dedup


def brute_bytes(docs, length=50):
    first, out = {}, {}
    rows = [(i, (t or "").encode()) for i, t in docs]
    for i, b in sorted(rows):
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        out[i] = (len(b), bytes(c for c, g in zip(b, gone, strict=True) if not g), sum(1 for x in range(len(b)) if gone[x] and (not x or not gone[x - 1])))
    return out


@pytest.mark.parametrize("block", [2000, 1 << 20])
def test_suffix_dedup(docs, block):
    got = by_id(suffix_dedup.remove_repeats(docs, block_bytes=block))
    for i, (n, kept, spans) in brute_bytes(DOCS).items():
        assert (got[i]["n_bytes"], bytes(got[i]["kept"]), len(got[i]["starts"])) == (n, kept, spans), i


def test_least_ids_against_slices():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 3000, dtype=np.uint8)
    starts = np.arange(0, 2940)
    ids = rng.integers(0, 50, len(starts))
    got = suffix_dedup.least_ids(text, starts, ids, 50)
    least = {}
    for s, i in zip(starts, ids, strict=True):
        k = text[s : s + 50].tobytes()
        least[k] = min(least.get(k, 99), int(i))
    assert got.tolist() == [least[text[s : s + 50].tobytes()] for s in starts]


def test_suffix_dedup_edges(spark, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    long = "abcdefghij" * 6
    d = spark.createDataFrame([(None, long), (3, long), (3, long)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, len(r["kept"])) for r in suffix_dedup.remove_repeats(d).collect())
    assert got == [(False, 60), (False, 60), (True, 0)]


# ------------------------------------------------- Jaccard join


def brute_classes(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()).split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,percent,block", [(3, 90, 1024), (5, 80, 1024), (3, 60, 8)])
def test_jaccard_classes(docs, k, percent, block):
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(jaccard_join.jaccard_classes(docs, k, percent, block=block)).items()}
    assert got == brute_classes(DOCS, k, percent)


def test_drop_near_duplicates(docs, spark, empty):
    want = {i for i, (_, c) in brute_classes(DOCS, 5, 80).items() if i == c}
    out = jaccard_join.drop_near_duplicates(docs, 5, 80)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want
    assert jaccard_join.jaccard_classes(empty).count() == 0


# ------------------------------------------------- line dedup


def brute_runs(docs, min_lines=2, min_words=50):
    """doc -> maximal repeated runs (first, end) over its lines with a word: for each line the longest run from there with an earlier copy."""
    seqs = {i: [(p, x) for p, x in enumerate((t or "").split("\n")) if x.encode().split()] for i, t in docs}
    places = [(i, q) for i in sorted(seqs) for q in range(len(seqs[i]))]
    at = collections.defaultdict(list)
    out = {i: [] for i in seqs}
    for i, q in places:
        s, longest = seqs[i], 0
        for a, b in at[s[q][1]]:
            n = 0
            while q + n < len(s) and b + n < len(seqs[a]) and s[q + n][1] == seqs[a][b + n][1]:
                n += 1
            longest = max(longest, n)
        at[s[q][1]].append((i, q))
        if longest and not any(e >= q + longest for _, e in out[i]):
            out[i].append((q, q + longest))
    words = lambda i, a, b: sum(len(x.encode().split()) for _, x in seqs[i][a:b])
    return seqs, {i: [(a, b) for a, b in runs if b - a >= min_lines or words(i, a, b) >= min_words] for i, runs in out.items()}


def brute_lines(docs, min_lines=2, min_words=50):
    seqs, runs = brute_runs(docs, min_lines, min_words)
    out = {}
    for i, t in docs:
        gone = {seqs[i][q][0] for a, b in runs[i] for q in range(a, b)}
        out[i] = "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in gone)
    return out


@pytest.mark.parametrize("min_lines,min_words", [(2, 50), (3, 20), (1, 5)])
def test_line_dedup(docs, min_lines, min_words):
    got = by_id(line_dedup.drop_repeated_lines(docs, min_lines, min_words))
    for i, text in brute_lines(DOCS, min_lines, min_words).items():
        assert (got[i]["text"] or "") == text, i
    assert line_dedup.drop_repeated_lines(docs).columns == docs.columns


LINES = "a b c d e f g".split()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_runs_of_few_lines(spark, seed):
    """Long runs over few distinct lines: overlaps, periods, runs inside of runs."""
    rng = random.Random(seed)
    base = [rng.choice(LINES) for _ in range(70)]
    texts = ["\n".join(base), "\n".join(base[5:60]), "\n".join(base[:30] + [""] + base[30:]), "\n".join(base[10:40] + ["x"] + base[20:64]), "a\n" * 21, "a\n" * 33, *["\n".join(rng.choice(LINES) for _ in range(rng.randrange(0, 12))) for _ in range(10)], "\n".join(base), None, ""]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for min_lines, min_words in ((2, 50), (4, 9)):
        got = by_id(line_dedup._marked(df, min_lines, min_words, "doc_id", "text").select("row.doc_id", "n_runs", F.coalesce("kept", "lines").alias("kept")))
        _, runs = brute_runs(sorted(rows), min_lines, min_words)
        for i, text in brute_lines(sorted(rows), min_lines, min_words).items():
            assert ("\n".join(got[i]["kept"]), got[i]["n_runs"]) == (text, len(runs[i])), (i, min_lines)


def test_line_dedup_ends(spark, empty):
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    rows = [(None, "a\nb\nc"), (5, "a\nb\nc"), (5, "a\nb\nc"), (5, "z\na\nb"), (6, "only"), (7, "only")]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    kept = [t for _, i, t in got if i == 5]
    assert got[0][1] == 5 and got[-1] == (True, 0, "") and [t for _, i, t in got if i > 5] == ["only", "only"]
    assert sorted(kept) in (["a\nb\nc", "a\nb\nc", "z"], ["", "", "z\na\nb"], ["c", "c", "z\na\nb"])


def test_line_dedup_uses_no_python(docs):
    plan = line_dedup.drop_repeated_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ------------------------------------------------- tokens, packing, store


def ids_of(text):
    return tokens.encoder(tokens.default_vocabulary()).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library():
    hard = ["IT'S we'LL. a'S!! ''s", "<|endoftext|> a<|startoftext|>b", "á ́b K Å", "İI ΑΣ ΑΣ.", "x\x1cy\r\nz\tq", "日本 ไทย กำ!", "", None, "a" * 5000, "_a_ a_b 1a! !!a", *[t for _, t in DOCS]]
    enc = tokens.encoder(tokens.default_vocabulary())
    assert enc.by_words
    for most in (1_000_000, 50):  # a table that is emptied again and again gives the same ids
        enc.most = most
        seen = 0
        for at, end, ids, bounds in enc.stream(pa.array(hard), 20_000):
            for i in range(at, end):
                assert ids[bounds[i - at] : bounds[i - at + 1]].tolist() == ids_of(hard[i]), hard[i]
                seen += 1
        assert seen == len(hard)


def test_encoder_of_other_rules_encodes_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    joined = Tokenizer(models.WordLevel({"[UNK]": 0, "a b": 1, "a": 2, "b": 3}, "[UNK]"))
    joined.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
    joined.save(str(tmp_path / "joined.json"))
    enc = tokens.encoder(str(tmp_path / "joined.json"))
    assert not enc.by_words
    ids, bounds = enc.coded(pa.array(["a b\na", None, "b"]))
    assert ids.tolist() == [1, 2, 3] and bounds.tolist() == [0, 2, 2, 3]


@pytest.mark.parametrize("windows,fan_in", [(16, 64), (2, 2)])
def test_packing(docs, windows, fan_in):
    rows = packing.pack(docs.repartition(5), 64, windows, fan_in=fan_in).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in DOCS:
        ids, at = [*ids_of(t), 1], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64 and at & (at - 1) == 0


def test_token_store(docs, spark, tmp_path, empty):
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, path)
    got, start = by_id(token_store.verify_store(spark, path)), 0
    whole = by_id(token_store.restore(spark, path))
    for i, t in sorted(DOCS):
        ids = [*ids_of(t), 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        assert whole[i]["ids"] == ids
        start += len(ids)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    files = sorted(p.name for p in (tmp_path / "store" / "recipes").glob("part-*"))
    order = [r["doc_id"] for f in files for r in spark.read.parquet(f"{path}/recipes/{f}").collect()]
    assert order == sorted(i for i, _ in DOCS)
    bad = chunks.withColumn("ids", F.concat(F.lit(b"\x01\x00"), F.col("ids")))
    bad.write.parquet(f"{path}2/chunks")
    with pytest.raises(Exception, match="does not match its address"):
        token_store.read_chunks(spark, f"{path}2").collect()
    for name, part, match in (("4", "chunks", "a chunk is missing"), ("5", "recipes", "do not match their manifest"), ("6", "manifests", "do not match their manifest")):
        shutil.copytree(tmp_path / "store", tmp_path / f"store{name}")
        shutil.rmtree(tmp_path / f"store{name}" / part)
        spark.read.parquet(f"{path}/{part}").where("n > 1" if part == "chunks" else "doc_id > 3" if part == "recipes" else "part > 0").write.parquet(f"{path}{name}/{part}")
        with pytest.raises(Exception, match=match):
            token_store.verify_store(spark, f"{path}{name}").collect()
    token_store.write_store(empty, f"{path}3")
    assert token_store.verify_store(spark, f"{path}3").count() == 0


def test_token_store_refuses_ids_that_do_not_fit(spark, tmp_path):
    with pytest.raises(Exception, match="do not fit in 2 bytes"):
        token_store.write_store(spark.createDataFrame([(1, "a")], "doc_id long, text string"), f"file://{tmp_path}/store", end_id=70_000)


def test_token_store_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "one two"), (None, "one two"), (4, "x"), (4, "x y"), (-1, "long " * 30_000), (2, None)]
    path = f"file://{tmp_path}/store"
    token_store.write_store(spark.createDataFrame([(i, t, 0, "k", 1) for i, t in rows], "doc_id long, text string, part int, row_key string, seq int"), path, end_id=9, width=4)
    got = sorted(token_store.verify_store(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [-1, 2, 4, 4, None, None]
    want = {i: collections.Counter() for i in dict(rows)}
    for i, t in rows:
        want[i][zlib.crc32(np.array([*ids_of(t), 9], "<u4").tobytes())] += 1
    for i, crcs in want.items():
        assert collections.Counter(r["ids_crc32"] for r in got if r["doc_id"] == i) == crcs
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got[:-1]]]).tolist()
    assert spark.read.parquet(f"{path}/chunks").agg(F.max("n")).first()[0] <= token_store.MAX_IDS


def test_chunk_ends_against_a_plain_loop():
    rng = np.random.default_rng(8)
    sizes = [0, 1, 127, 128, 129, 5000, 20_000, 300, 0, 9000]
    bounds = np.cumsum([0, *sizes])
    marks = np.unique(rng.integers(0, bounds[-1], 60))
    ends, counts = token_store.chunk_ends(marks, bounds)
    want = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        start, mine = int(a), []
        for p in range(int(a) + 1, int(b) + 1):
            if p == b or p - start == token_store.MAX_IDS or (p - start >= token_store.MIN_IDS and p in marks):
                mine.append(p)
                start = p
        want.append(mine or [int(b)])
    assert ends.tolist() == [x for m in want for x in m] and counts.tolist() == [len(m) for m in want]


def test_crc_join():
    a, b = b"hello world", b"\x00" * 1000 + b"tail"
    assert token_store.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


# ------------------------------------------------- WARC


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 120 + "é</p>"
    pages = [(5, "http://a/1", big), (2, "http://a/2", big), (3, "http://b", None), (4, None, ""), (7, "http://c", "short"), (8, "http://c", "short")]
    path = f"file://{tmp_path}/warc"
    warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    got = {r["page_id"]: r for r in warc.read_archive(spark, path).collect()}
    for i, _, h in pages:
        body = (h or "").encode()
        assert bytes(got[i]["payload"]) == body and got[i]["payload_digest"] == hashlib.sha256(body).hexdigest()
        record = bytes(got[i]["record"])
        assert record.startswith(b"WARC/1.1\r\n") and record == bytes(got[i]["header"]) + (b"" if i == 5 else body) + b"\r\n\r\n"
    assert [got[i]["record_type"] for i in (2, 5, 7, 8)] == ["response", "revisit", "response", "response"] and got[5]["refers"] == "2"
    assert spark.read.parquet(f"{path}/payloads").count() == 3


# ------------------------------------------------- embeddings


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 16))
    v = [base[i % 30] + rng.normal(size=16) * 0.02 * (i % 4) for i in range(150)] + [rng.normal(size=16) for _ in range(100)]
    rows = [(i, [float(x) for x in a], 1) for i, a in enumerate(v)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None] * 8, 1), (904, [], 1), (905, rows[0][1], 1), (906, [2 * x for x in rows[0][1]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, block=16).collect()}
    use = [(i, np.array(a)) for i, a, _ in rows if i < 900 or i > 904]
    u = np.stack([a / np.linalg.norm(a) for _, a in use])
    cos = u @ u.T
    np.fill_diagonal(cos, -1)
    want = (cos >= 0.95).sum(1)
    have = np.array([got[i]["n_links"] for i, _ in use])
    assert (have <= want).all() and have.sum() >= 0.97 * want.sum()
    assert all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i in range(900, 905))
    assert got[905]["component_id"] == got[906]["component_id"] == got[0]["component_id"] == 0
    assert len(got) == len(rows)


# ------------------------------------------------- mixing


def test_quota_targets():
    # 315 words by 5 : 2 : 1; null stops at 20, then a at 200
    t = mixing.quota_targets([("a", 100), ("b", 100), (None, 10)])
    assert t == pytest.approx({"a": 200.0, "b": 95.0, None: 20.0})
    t = mixing.quota_targets([("b", 100), ("a", 60), (None, 50)])
    assert t == pytest.approx({"a": 120.0, "b": 130.0, None: 65.0})


def test_mixing_overlapping_sources(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 50), rng.choice([["a"], ["b"], ["a", "b"], None, ["c", "a", "c"]])) for i in range(400)] + [(400, None, ["b"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, src array<string>")
    got, targets, routed = mixing.mix_sources(df, F.col("src"))
    out = got.collect()
    assert len(out) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    by = collections.Counter()
    for r in out:
        by[tuple(r["pattern"])] += r["taken"]
    for p in by:
        assert by[p] == pytest.approx(sum(x for (q, _), x in routed.items() if q == p), abs=1)
    for s, t in targets.items():
        name = mixing.NULL_SOURCE if s is None else s
        assert sum(x for (_, q), x in routed.items() if q == name) == pytest.approx(t, rel=1e-6)
    again, _, _ = mixing.mix_sources(df.repartition(5), F.col("src"))
    assert {(r["doc_id"], r["taken"]) for r in again.collect()} == {(r["doc_id"], r["taken"]) for r in out}


def test_flow_prefers_first_copies():
    routed = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 100.0, "b": 100.0})
    assert sum(routed.values()) == pytest.approx(200)
    used = {p: sum(x for (q, _), x in routed.items() if q == p) for p in (("a",), ("a", "b"), ("b",))}
    assert all(used[p] <= n + 1e-6 for p, n in ((("a",), 100), (("a", "b"), 100), (("b",), 10)))  # 210 words are there: none twice


def least_cost(patterns, targets, tiers):
    """Least cost of a routing that takes the most words, by trying every whole routing."""
    pats, names = sorted(patterns), sorted(targets)
    links = [(p, s) for p in pats for s in names if s in p]
    best = (0, 0)

    def cost(used):
        return sum(sum(k * k * min(patterns[p], max(0, used[p] - k * patterns[p])) for k in range(tiers)) for p in pats)

    def walk(i, left, used):
        nonlocal best
        if i == len(links):
            best = min(best, (-sum(used.values()), cost(used)))
            return
        p, s = links[i]
        for x in range(min(left[s], tiers * patterns[p] - used[p]) + 1):
            walk(i + 1, left | {s: left[s] - x}, used | {p: used[p] + x})

    walk(0, dict(targets), dict.fromkeys(pats, 0))
    return -best[0], best[1]


def test_flow_is_of_least_cost():
    rng = random.Random(6)
    for _ in range(25):
        patterns = {p: rng.randrange(1, 5) for p in rng.sample([("a",), ("b",), ("c",), ("a", "b"), ("b", "c"), ("a", "b", "c")], 3)}
        targets = {s: rng.randrange(0, 7) for s in sorted({s for p in patterns for s in p})}
        routed = mixing.route(patterns, {s: float(t) for s, t in targets.items()}, 3)
        used = {p: sum(x for (q, _), x in routed.items() if q == p) for p in patterns}
        cost = sum(sum(k * k * min(n, max(0.0, used[p] - k * n)) for k in range(3)) for p, n in patterns.items())
        assert (sum(used.values()), cost) == pytest.approx(least_cost(patterns, targets, 3), abs=1e-5)


def test_packing_task_leaves_no_cache(monkeypatch):
    monkeypatch.setattr(packing, "_first_id", lambda level: level << 56)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words here", None])], names=["doc_id", "text"])
    run = packing._pack(tokens.default_vocabulary(), 1, 2048, 16, 300_000)
    plain = pa.Table.from_batches(run(iter([batch])))
    assert tokens._open
    assert pa.Table.from_batches(tidy(run)(iter([batch]))).equals(plain) and not tokens._open


# ------------------------------------------------- quality


def test_base_counts():
    text = "\n".join(["a b c d e f g h i", "###", "a b c d e f g h i", "", "", "é"])
    assert quality.base_counts(text) == (20, 22, 3, 1, 18)
    assert quality.base_counts(None) == (0, 0, 0, 0, 0)


def test_repeat_words_brute():
    rng = random.Random(1)
    for _ in range(30):
        w = [rng.choice("abc") for _ in range(rng.randrange(0, 60))]
        n = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert quality.repeat_words(" ".join(w).encode()) == len(hit)


def test_quality_uses_every_label(spark):
    """More labels than the 20,000 that once were the most: the counts are those of all."""
    n = 24_000
    docs = spark.createDataFrame([(i, "abcd"[i % 4] * 2 + "xyz"[i % 3]) for i in range(n)] + [(None, "qq"), (n + 5, "rr"), (7, "again")], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(n)] + [(7, 0), (n + 9, 1), (None, 1)], "doc_id long, quality int")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    good = {i for i in range(n) if i % 5} - {7}
    count = lambda keep: np.bincount(np.concatenate([quality.gram_bins(t.encode()) for i, t in texts if keep(i)]), minlength=1 << quality.BINS_LOG2)
    raw, target = count(lambda i: True), count(lambda i: i in good)
    prior = (raw + 0.2) / (raw.sum() + 0.2 * len(raw))
    share = (target + 0.2 * len(raw) * prior) / (target.sum() + 0.2 * len(raw))
    got = quality.fit(docs, labels).ratios
    assert np.allclose(got, np.log(share / prior), atol=1e-6)


def test_quality_held_out(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(60))
    junk = lambda: " ".join(rng.choice(WORDS).upper() + "!!###" for _ in range(60))
    rows = [(i, good() if i % 4 else junk()) for i in range(400)] + [(400, None), (401, "")]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, quality string, score int")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 3)], "doc_id long, quality int")
    kept = quality.filter_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(400) if i % 4}
    assert quality.filter_documents(docs, labels.where("quality > 5")).count() == 400


# ------------------------------------------------- HTML

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="<p>x</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<div id="content"><h1>Title {n}</h1><p>Some &amp; text&nbsp;{n}<br>more <b>bold</b>  words<p>Second {n} &lt;tag&gt;</p><form><p>Name</p></form>
<div class="comments"><p>Nice post {n}</p></div></div><p>Standing line of the site</p><aside>Side {n}</aside><footer>&copy; x</footer></body></html>"""


def test_html_template(spark):
    rows = [(n, "http://h.example/x", PAGE.format(n=n)) for n in range(12)] + [(50, None, None), (51, "nonsense", "<p>a<p>b <i>c</i><div>d"), (52, "http://one/", "<article><h1>H</h1><ul><li>x<li>y</ul></article><p>no</p><p cut")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    for n in range(12):
        assert got[n] == f"Title {n}\nSome & text {n} more bold words\nSecond {n} <tag>", n
    assert got[50] == "" and got[51] == "a\nb c\nd" and got[52] == "H\nx\ny"
    assert html_extract.extract(df.limit(0)).count() == 0


def _texts(spark, pages):
    df = spark.createDataFrame([(n, "http://h.example/x", p) for n, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    return [got[n] for n in range(len(pages))]


def test_html_keeps_the_text_beside_the_deepest_element(spark):
    body = "".join(f"<p>long text {{n}} of paragraph {k}</p>" for k in range(4))
    text = "\n".join(f"long text {{n}} of paragraph {k}" for k in range(4))
    nested = f'<body><article><h1>T {{n}}</h1><p class=lead>L {{n}}</p><div class=body>{body}</div></article></body>'
    single = "<body><article><h1>T {n}</h1><p>a single long paragraph {n}</p></article></body>"
    plain = f'<body><div class=page><h1>T {{n}}</h1><p class=lead>L {{n}}</p><div class=body>{body}</div></div><p>Standing line</p></body>'
    for page, want in ((nested, f"T {{n}}\nL {{n}}\n{text}"), (single, "T {n}\na single long paragraph {n}"), (plain, f"T {{n}}\nL {{n}}\n{text}")):
        assert _texts(spark, [page.format(n=n) for n in range(8)]) == [want.format(n=n) for n in range(8)]


def test_html_copied_articles_keep_their_text(spark):
    page = "<body><nav>menu {m}</nav><div class=page><h1>T {n}</h1><p>first {n}</p><p>second {n}</p></div><p>Standing line</p></body>"
    text = "T {n}\nfirst {n}\nsecond {n}"
    which = [0] * 9 + [1, 2, 3, 4, 5]
    assert _texts(spark, [page.format(n=n, m=m) for m, n in enumerate(which)]) == [text.format(n=n) for n in which]
    shared = "<body><div class=page><h1>T {n}</h1><p>{p}</p><p>own {n}</p></div></body>"
    passage = lambda n: "shared passage" if n % 4 else f"another {n}"
    assert _texts(spark, [shared.format(n=n, p=passage(n)) for n in range(12)]) == [f"T {n}\n{passage(n)}\nown {n}" for n in range(12)]
    assert _texts(spark, [page.replace("<p>Standing line</p>", "").format(n=0, m=m) for m in range(8)]) == [text.format(n=0)] * 8


SHOP = """<body><div class=top><ul><li><a href=1>Start {n}</a></li><li><a href=2>News {m}</a></li></ul></div><article><h1>T {n}</h1><p>Read on our site</p>
<p>long text {n} of the article {m}</p><p>{n} MORE</p></article><div class=x7>Buy {m} now</div></body>"""
PLAIN = """<body><div class=top><ul><li><a href=1>Start {n}</a></li><li><a href=2>News {m}</a></li></ul></div><div class=c><h1>T {n}</h1>
<p>long text {n} of the article {m}</p><p>{n} MORE</p><p>Read on our site</p></div><p>Standing line</p></body>"""
MORE = "words of a longer second block that make the site's own line a small part of the article's text, " * 3


def test_html_template_changes_the_text(spark):
    """What the template knows of a host: its own line inside of the article, a menu without a telling name, a standing line."""
    want = "T {n}\nlong text {n} of the article {m}\n{n} " + MORE.strip()
    for page in (SHOP, PLAIN):
        pages = [page.replace("MORE", MORE).format(n=n, m=n * n + 7) for n in range(15)]
        got = _texts(spark, pages)
        assert got == [want.format(n=n, m=n * n + 7) for n in range(15)]
        assert all("Read on our site" in html_extract.main_text(p) and html_extract.main_text(p) != t for p, t in zip(pages, got, strict=True))
        assert _texts(spark, pages[:4]) == [html_extract.main_text(p) for p in pages[:4]]  # too few pages for a class


def brute_tokens(pages, min_pages, share):
    """token -> its count on each distinct page of the host, where it stands on enough of them."""
    distinct = {}
    for p in pages:
        digest, tokens = html_extract.page_tokens(p)
        distinct.setdefault(digest, {t[0]: t for t in tokens})
    vectors = collections.defaultdict(lambda: [0] * len(distinct))
    for k, tokens in enumerate(distinct.values()):
        for t, row in tokens.items():
            vectors[t][k] = row[3]
    return {t: tuple(v) for t, v in vectors.items() if sum(map(bool, v)) >= max(min_pages, share * len(distinct))}, distinct


def test_html_classes_against_whole_vectors(spark):
    rng = random.Random(4)
    hosts = {}
    for h in range(6):
        page = [SHOP, PLAIN, PAGE][h % 3]
        hosts[f"h{h}.example"] = [page.format(n=rng.randrange(9), m=rng.randrange(5)) + rng.choice(["", "", "<p>x</p>", "<p>x</p><p>y</p>"]) for _ in range(3 + 4 * h)]
    rows = [(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate((h, p) for h, ps in hosts.items() for p in ps)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    found = {r["host"]: r for r in html_extract.deduce_templates(df).collect()}
    for h, ps in hosts.items():
        vectors, distinct = brute_tokens(ps, 5, 0.5)
        if len(distinct) < 5:
            assert h not in found
            continue
        numbers = {v: k for k, v in enumerate(sorted(set(vectors.values())))}
        tokens = []
        for t, v in vectors.items():
            rows_of = [d[t] for d in distinct.values() if t in d]
            tokens.append({"token": t, "path": rows_of[0][1], "up": rows_of[0][2], "w1": numbers[v], "w2": 0, "pages": len(rows_of), "total": sum(v), "chars": sum(r[4] for r in rows_of), "links": sum(r[5] for r in rows_of)})
        want = html_extract.nest(tokens, len(distinct), 5)
        assert (found[h]["content"], found[h]["menus"], found[h]["own"]) == (want.content, want.menus, want.own), h


def test_html_near_copies_keep_shared_paragraphs(spark):
    """All pages of a host share most paragraphs of their article: these are no template."""
    page = "<body><nav>menu</nav><article><h1>T</h1><p>a long first paragraph that all share</p><p>a long second paragraph that all share</p><p>changed {n}</p></article></body>"
    assert _texts(spark, [page.format(n=n) for n in range(14)]) == [f"T\na long first paragraph that all share\na long second paragraph that all share\nchanged {n}" for n in range(14)]


def test_html_class_names_are_evidence_only():
    text = lambda page: html_extract.main_text(page)
    article = "<article><h1>T</h1><p>body</p></article>"
    plain = "<h1>T</h1><p>body of the page</p>"
    for name in ("content with-sidebar", "search-results-page", "search", "widget"):
        assert text(f"<div class='{name}'>{article}</div><div class=sidebar>no</div>") == "T\nbody", name
        assert text(f"<div id='{name}'>{plain}</div><div class=sidebar>no</div>") == "T\nbody of the page", name
    assert text("<div class='entry-header'><h1>T</h1></div><p>body</p><div class='x comments'>no</div><div class=share-social>no</div>") == "T\nbody"
    assert text(f"<div class=widget>{article}<ol class=comments><li><article>a</article></ol></div>") == "T\nbody"


@pytest.mark.parametrize("tag", ["<svg class=i/>", "<math/>", "<svg><title/><script/></svg>", "<svg><svg></svg>x</svg>", "<button>", "<canvas>", "<option>", "<button><!-- </button> -->", "<select><option>a<option>b</select>", "<video-caption></video-caption>", "<title-x/>"])
def test_html_skipped_elements_end(tag):
    page = f"<article><h1>T</h1>{tag}<p>body</p><button>no</button><p>end</p></article>"
    assert html_extract.main_text(page) == "T\nbody\nend"


def test_html_raw_text_ends_with_the_page():
    assert html_extract.main_text("<p>a</p><button>no</button><script>var a = '<p>x</p>'") == "a"


def test_warc_measures_the_rebuilt_record(spark, tmp_path):
    pages = [(1, "http://a/", "é" * 200), (2, "http://b/", "é" * 200), (3, None, None)]
    path = f"file://{tmp_path}/warc"
    warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    back = warc.read_archive(spark, path)
    got = {r["page_id"]: r for r in warc.measured(back).collect()}
    for n, _, html in pages:
        body = (html or "").encode()
        assert (got[n]["payload_bytes"], got[n]["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
    with pytest.raises(Exception, match="record is not whole"):
        warc.measured(back.withColumn("record", F.expr("substring(record, 1, octet_length(record) - 5)"))).collect()


def test_warc_urls_cannot_forge_headers(spark, tmp_path):
    forged = "http://a/\r\nWARC-Type: revisit\u2028WARC-Refers-To: <urn:page:77:1>\u0085WARC-Payload-Digest: sha256:" + "a" * 64 + "\n\nx\u2029 \x00é"
    pages = [(1, forged, "x" * 200), (2, forged, "x" * 200), (2, "http://b", "x" * 200), (None, None, None), (None, "u", None), (5, "http://c/%0d%0a", "y" * 50_000)]
    path = f"file://{tmp_path}/warc"
    warc.write_archive(spark.createDataFrame([(*p, 1, "d") for p in pages], "page_id long, url string, html string, payload int, digest string"), path)
    back = warc.read_archive(spark, path).cache()
    got = sorted(warc.measured(back).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0))
    assert [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers"]) for r in got] == [(1, 200, "response", ""), (2, 200, "revisit", "1"), (2, 200, "revisit", "1"), (5, 50_000, "response", ""), (None, 0, "response", ""), (None, 0, "response", "")]
    heads = [bytes(r["header"]) for r in back.collect()]
    assert all(h.endswith(b"\r\n\r\n") and h.count(b"\r\n\r\n") == 1 and len(h.decode().splitlines()) == h.count(b"\r\n") for h in heads)
    names = [re.search(rb"WARC-Record-ID: (\S+)\r\n", h)[1] for h in heads]
    assert len(set(names)) == len(pages) and all(b"\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in h for h in heads)
    assert sum(b"\r\nWARC-Profile: " in h for h in heads) == 2
    assert {r["url"] for r in back.collect() if r["page_id"] == 1} == {"http://a/%0D%0AWARC-Type:%20revisit%E2%80%A8WARC-Refers-To:%20<urn:page:77:1>%C2%85WARC-Payload-Digest:%20sha256:" + "a" * 64 + "%0A%0Ax%E2%80%A9%20%00é"}
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"{path}2")
    assert warc.read_archive(spark, f"{path}2").count() == 0


def test_embedding_recall_just_above_the_threshold():
    hashes, tables = embedding_dedup.table_plan(8000, 0.95, 1.0)
    assert (hashes, tables) == embedding_dedup.table_plan(60_000, 0.95, 1.0) == (6, 32) and embedding_dedup.table_plan(10**9, 0.95, 1.0)[0] == 14
    for d in (0.3, 1.0, 1.4):
        cells = np.random.default_rng(1).normal(size=200_000) * d
        assert embedding_dedup.same_cell(d, 1.0) == pytest.approx(np.clip(1 - np.abs(cells), 0, 1).mean(), abs=0.005)
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a = unit(rng.normal(size=(8000, 64)))
    r = rng.normal(size=a.shape)
    cos = rng.uniform(0.95, 0.97, (len(a), 1))
    b = cos * a + np.sqrt(1 - cos**2) * unit(r - (r * a).sum(1, keepdims=True) * a)
    ka, kb = (embedding_dedup.table_keys(v, tables, hashes, 1.0, 7) for v in (a, b))
    recall = (ka == kb).any(1).mean()
    assert recall >= 0.995
