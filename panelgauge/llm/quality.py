"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Byte n-grams of every whole text are hashed into a fixed number of bins. Bin
counts over all documents give the raw multinomial; counts over the trusted
documents (labelled quality 1) give the target multinomial. A document's score
is the sum of log(target / raw) over its n-grams divided by their number. Every
document is kept or rejected by one fixed threshold: the cut with the least
balanced error on the labelled documents.

Every label counts: the raw multinomial covers every document, the target every
document labelled 1, the threshold every labelled one. Labels are joined by
shuffles; a bitmap of fixed size, broadcast, first leaves out documents that
surely have none, so that few other texts travel (never the result depends on it).

Defined results
  null or empty text    no words, base_failed, not kept
  null id               scored like any other, without a label
  repeated rows, ties   each row has its own result; a label counts once per id (the worst, if several differ)
  no usable labels      every ratio is 0 and the threshold keeps what passes the base rules
  very long text        read whole, one document at a time
  empty table           no rows
  other columns         passed through in one struct, whatever their names
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_BYTES, gram_hashes, release_caches, tidy, word_hashes, write_cut

BINS_LOG2 = 16
ORDERS = (2, 3, 4)
#: Bits of the bitmap of labelled ids (2 MB).
CELLS_LOG2 = 24
#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
_C = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def gram_bins(raw: bytes) -> np.ndarray:
    """The bins of the text's byte n-grams of all orders."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = []
    shift = np.uint32(32 - BINS_LOG2)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(b) < n:
                continue
            h = np.full(len(b) - n + 1, n, np.uint32)
            for j in range(n):
                h = (h ^ b[j : len(b) - n + 1 + j]) * _C[j]
                h ^= h >> np.uint32(15)
            out.append((h * _C[0]) >> shift)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def repeat_words(raw: bytes, window: int = 8) -> int:
    """Words inside windows of so many words that occur twice or more, the first included."""
    h = gram_hashes(word_hashes(raw), window)
    n = len(h)
    if n < 2:
        return 0
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(n + window, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return int((np.cumsum(step) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    n_words = len(raw.split())
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACE_BYTES)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE_BYTES)]
    return n_words, word_chars, n_symbols, len(lines) - len(set(lines)), repeat_words(raw)


@dataclass(frozen=True)
class QualityModel:
    """log ratio per bin and the threshold."""

    ratios: np.ndarray
    threshold: float


def _count_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_caches()
    counts = np.zeros(1 << BINS_LOG2, np.int64)
    held, n = [], 0
    for b in batches:
        for text in b.column(0).to_pylist():
            bins = gram_bins((text or "").encode())
            held.append(bins)
            n += len(bins)
            if n > 2_000_000:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
                held, n = [], 0
    if held:
        counts += np.bincount(np.concatenate(held), minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bin", "n"])


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _score(ratios: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for b in batches:
            counts, scores = [], []
            for t in b.column(0).to_pylist():
                counts.append(base_counts(t))
                bins = gram_bins((t or "").encode())
                scores.append(float(ratios[bins].sum(dtype=np.float64) / len(bins)) if len(bins) else 0.0)
            c = np.array(counts, np.int64).reshape(-1, 5)
            failed = (c[:, 0] < 20) | (100 * c[:, 4] > 30 * c[:, 0])
            s = np.array(scores, np.float64)
            found = pa.StructArray.from_arrays([*[pa.array(c[:, i]) for i in range(5)], pa.array(s), pa.array(failed), pa.array(~failed & (s >= threshold))], names=[*RULES, "score", "base_failed", "kept"])
            yield pa.RecordBatch.from_arrays([b.column(1), found], names=["row", "quality"])

    return run


def labelled(labels: DataFrame) -> DataFrame:
    """label_id and quality: one row per labelled id."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").cast("int").alias("quality"))


def may_be_labelled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows (label_id, text) whose id may be among the known: all that are, and a few others."""
    cell = F.pmod(F.xxhash64("label_id"), F.lit(1 << CELLS_LOG2)) + 1
    bucket, at = F.bitmap_bucket_number(cell), F.bitmap_bit_position(cell)
    bits = known.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(at).alias("bits"))  # at most 2**CELLS_LOG2 bits in all
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.where("label_id IS NOT NULL").withColumn("bucket", bucket).join(F.broadcast(bits), "bucket").where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("label_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _bin_counts(texts: DataFrame) -> np.ndarray:
    out = np.zeros(1 << BINS_LOG2)
    for r in texts.mapInArrow(tidy(_count_bins), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most 2**BINS_LOG2 rows
        out[r["bin"]] = r["n"]
    return out


def fit_ratios(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", smoothing: float = 2.0) -> np.ndarray:
    """log(target / raw) per bin, from counts over all documents and over all that are known as good."""
    rows = _identified(docs, id_col, text_col)
    good = known.where("quality = 1").select("label_id")
    raw, target = _bin_counts(rows.select("text")), _bin_counts(may_be_labelled(rows, good).join(good, "label_id").select("text"))
    if not target.sum():
        return np.zeros(1 << BINS_LOG2, np.float32)
    prior = (raw + smoothing / 10) / (raw.sum() + smoothing / 10 * len(raw))
    strength = smoothing * len(raw) / 10
    share = (target + strength * prior) / (target.sum() + strength)
    return np.log(share / prior).astype(np.float32)


def best_threshold(bins: list[tuple[int, int, int]], step: float) -> float:
    """The cut with the least balanced error over (bin, rejects, accepts); the middle of the widest stretch of equal cuts."""
    bad, good = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not bad or not good:
        return -np.inf
    bins = sorted(bins)
    best, cut = np.inf, -np.inf
    below_bad = below_good = 0
    for i, (at, b, g) in enumerate(bins):
        below_bad, below_good = below_bad + b, below_good + g
        nxt = bins[i + 1][0] if i + 1 < len(bins) else at + 1
        error = below_good / good + (bad - below_bad) / bad
        gap = nxt - at
        if error < best - 1e-12 or (abs(error - best) <= 1e-12 and gap > width):
            best, cut, width = error, (at + 1 + nxt) / 2 * step, gap
    return float(cut)


_found_ddl = "struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, score: double, base_failed: boolean, kept: boolean>"


def score_documents(docs: DataFrame, ratios: np.ndarray, threshold: float = -np.inf, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns of docs, or of those named) and quality (the base counts, score, base_failed and kept) of every row."""
    base = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`").alias(c) for c in columns or docs.columns]).alias("row"))
    schema = T.StructType([base.schema["row"], T.StructField("quality", T._parse_datatype_string(_found_ddl))])
    return base.mapInArrow(tidy(_score(ratios, threshold)), schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", step: float = 1e-4) -> QualityModel:
    """Ratios from all documents; the threshold from all labelled ones, as scored by those ratios."""
    known = write_cut(labelled(labels), "labels")
    ratios = fit_ratios(docs, known, id_col, text_col)
    # only ids and scores travel to the labels
    scores = score_documents(may_be_labelled(_identified(docs, id_col, text_col), known), ratios, columns=["label_id"])
    judged = scores.where("NOT quality.base_failed").select("row.label_id", "quality.score").join(known, "label_id")
    label = F.col("quality")
    hist = judged.groupBy(F.floor(F.col("score") / step).cast("long").alias("at")).agg(F.sum((label == 0).cast("long")).alias("bad"), F.sum((label == 1).cast("long")).alias("good"))
    return QualityModel(ratios, best_threshold([(r["at"], r["bad"], r["good"]) for r in hist.collect()], step))  # one row per step of the scores' range


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    model = fit(docs, labels, id_col, text_col)
    return score_documents(docs, model.ratios, model.threshold, text_col).where("quality.kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored against the labelled target."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    q = score_documents(docs, model.ratios, model.threshold)
    return q.select("row.doc_id", *[F.col(f"quality.{n}").alias(n) for n in (*RULES, "base_failed", "kept", "score")])
