"""Each pipeline stage against a brute-force version of its own input."""

import collections
import os

import pytest

import corpus_pipeline as P

from test_exact import brute_classes, brute_lines, ids_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at, out = str(tmp_path_factory.mktemp("stages")), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, stage) in enumerate(P.STAGES):
        done = stage(spark, docs, SF)
        done.write.parquet(f"{at}/{i}")
        out.append((docs.collect(), spark.read.parquet(f"{at}/{i}").collect(), docs.columns))
        docs = spark.read.parquet(f"{at}/{i}")
    return out


def test_columns_stay(stages):
    for before, after, cols in stages[:4]:
        assert after and list(after[0].asDict()) == cols and len(before)


def test_quality_keeps_clean_and_drops_rejected(spark, stages):
    before, after, _ = stages[0]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    known = [r for r in before if r["doc_id"] in labels and len((r["text"] or "").split()) >= 20]
    right = sum((r["doc_id"] in kept) == bool(labels[r["doc_id"]]) for r in known)
    assert right >= 0.93 * len(known)
    assert {(r["doc_id"], r["text"]) for r in after} <= {(r["doc_id"], r["text"]) for r in before}


def test_lines(stages):
    before, after, _ = stages[1]
    want = brute_lines([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_duplicates(stages):
    before, after, _ = stages[2]
    want = {i for i, (_, c) in brute_classes([(r["doc_id"], r["text"]) for r in before], 5, 80).items() if i == c}
    assert {r["doc_id"] for r in after} == want and len(after) == len(want)


def test_mixing(stages):
    before, after, _ = stages[3]
    copies = collections.Counter(r["doc_id"] for r in after)
    assert set(copies) <= {r["doc_id"] for r in before} and max(copies.values()) <= 2
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in before}
    total = sum(size.values())
    assert sum(size[i] * n for i, n in copies.items()) == pytest.approx(1.5 * total, rel=0.1)


def test_packing(stages):
    before, after, _ = stages[4]
    want = sum(len(ids_of(r["text"])) + 1 for r in before)
    assert sum(r["length"] for r in after) == want
    by = collections.defaultdict(int)
    for r in after:
        by[r["sequence_id"]] += r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in by.values())


def test_run_is_the_stages(spark, stages):
    assert P.run(spark, SF).count() == len(stages[4][1])
