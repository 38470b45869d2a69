"""Suffix-array dedup of long byte matches by blockwise, difference-cover suffix sorting.

A byte is removed when a ``length``-byte string that covers it also starts in a
document with a smaller id. Only suffixes at least that long matter, compared on
that many bytes, so they can be sorted one bucket at a time:

0. Texts are laid into blocks of about ``block_bytes`` in scan order, each block in
   ascending id order, in a table bucketed by block: later passes join small
   answers to the blocks without moving the texts.
1. Each suffix belongs to the bucket of the least hash among the 20-byte strings
   in its first ``length`` bytes; equal suffixes share it. Each block sends its
   distinct bucket keys once; keys seen in one document only cannot start a match.
2. The remaining suffixes travel as segments (a run of neighbouring suffixes of one
   bucket with the bytes they cover). Equal segments of a block travel once.
3. A task sorts one suffix bucket at a time. Sample positions (a difference cover
   modulo 7) are ranked first; two suffixes whose first and last eight bytes tie
   are resolved by the ranks of the sample positions both reach at the same
   offset, so no comparison runs along the text and memory is bounded by the bucket.
4. The least id of each class of equal suffixes goes back to the blocks as runs.

Defined results
  null text          no bytes
  null id            ranks after all others; equal ids never remove from each other
  short texts        shorter than ``length``: nothing is removed
  repeated rows      rows of the same id have the same result
  very long texts    a block of their own; a suffix reads ``length`` bytes, however long its text
  empty table        no rows
  other columns      ignored, whatever their names
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, scratch_table, write_cut

GRAM = 20
LAST_ID = np.iinfo(np.int64).max
MAX_RUN = 64
COVER, MODULUS = (0, 1, 3), 7
_rng = np.random.default_rng(99)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = [np.uint64(x) for x in (_rng.integers(1, 2**62, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).tolist()]


def gram_values(b: np.ndarray) -> np.ndarray:
    """A hash of each GRAM-byte string."""
    with np.errstate(over="ignore"):
        h = {1: _BYTE[b]}
        for i, n in enumerate((1, 2, 4, 8)):
            h[2 * n] = h[n][:-n] * _STEP[i] + h[n][n:]
        return mix(h[16][: len(b) - GRAM + 1] * _STEP[4] + h[4][16:])


def window_keys(b: np.ndarray, length: int) -> np.ndarray:
    """For each start: the least gram value in the next ``length`` bytes."""
    if len(b) < length:
        return np.zeros(0, np.uint64)
    m, n, span = gram_values(b), 1, length - GRAM + 1
    while 2 * n <= span:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    if n < span:
        m = np.minimum(m[: len(m) - (span - n)], m[span - n :])
    return m


class Block:
    """Documents laid end to end, ascending by id."""

    def __init__(self, ids: bytes, ends: bytes, data: bytes):
        self.ids, self.ends, self.data = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64), data
        self.starts = np.r_[0, self.ends[:-1]]

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start, number of suffixes, key and document of each run of neighbouring suffixes of one bucket."""
        b = np.frombuffer(self.data, np.uint8)
        keys = window_keys(b, length)
        if not len(keys):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        valid = np.zeros(len(keys) + 1, np.int8)
        np.add.at(valid, np.minimum(self.starts, len(keys)), 1)
        np.add.at(valid, np.minimum(np.maximum(self.ends - length + 1, self.starts), len(keys)), -1)
        inside = np.cumsum(valid[:-1]) > 0
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (inside[1:] != inside[:-1])
        new[self.starts[self.starts < len(keys)]] = True
        at = np.flatnonzero(new)
        n = np.diff(np.r_[at, len(keys)])
        ok = inside[at]
        at, n = at[ok], n[ok]
        parts = -(-n // MAX_RUN)
        if (parts > 1).any():
            base = np.repeat(at, parts)
            step = np.arange(len(base)) - np.repeat(np.cumsum(parts) - parts, parts)
            total = np.repeat(n, parts)
            at, n = base + step * MAX_RUN, np.minimum(MAX_RUN, total - step * MAX_RUN)
        return at, n, mix(keys[at], 3), np.searchsorted(self.ends, at, "right")


# ------------------------------------------------- pass 0: blocks


def _lay(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple[int, bytes]] = []
        size = 0

        def block() -> pa.RecordBatch:
            rows.sort(key=lambda r: r[0])
            ids = np.array([r[0] for r in rows], np.int64)
            ends = np.cumsum([len(r[1]) for r in rows]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([first + n], pa.int64()), *[pa.array([x], pa.binary()) for x in (ids.tobytes(), ends.tobytes(), b"".join(r[1] for r in rows))]], names=["g", "ids", "ends", "data"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows.append((LAST_ID if i is None else i, t or b""))
                size += len(t or b"") + 16
                if size >= block_bytes:
                    yield block()
                    rows, size, n = [], 0, n + 1
        if rows:
            yield block()

    return run


# ------------------------------------------------- pass 1: keys seen in more than one document


def _send_keys(length: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, ids, ends, data in zip(*[b.column(i) for i in range(4)], strict=True):
                _, _, keys, _ = Block(ids.as_py(), ends.as_py(), data.as_py()).runs(length)
                keys = np.unique(keys)
                if not len(keys):
                    continue
                bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
                low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                yield pa.RecordBatch.from_arrays([pa.array(bucket[np.r_[0, cuts]], pa.int64()), pa.array([g.as_py()] * (len(cuts) + 1), pa.int64()), pa.array([x.tobytes() for x in np.split(low, cuts)], pa.binary())], names=["bucket", "g", "keys"])

    return run


_answer = pa.schema([("g", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary())])


def _shared_keys(group: pa.Table) -> pa.Table:
    blobs = [np.frombuffer(x.as_py(), "<u4") for x in group.column("keys")]
    own = np.repeat(np.arange(len(blobs)), [len(x) for x in blobs])
    keys = np.concatenate(blobs)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    shared = np.zeros(len(keys), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    cuts = np.cumsum([len(x) for x in blobs])[:-1]
    parts = np.split(shared, cuts)
    hit = [i for i, p in enumerate(parts) if p.any()]
    gs = group.column("g").to_pylist()
    return pa.Table.from_arrays([pa.array([gs[i] for i in hit], pa.int64()), pa.array([group.column("bucket")[0].as_py()] * len(hit), pa.int64()), pa.array([blobs[i][parts[i]].tobytes() for i in hit], pa.binary())], schema=_answer)


# ------------------------------------------------- pass 2: segments

_segments = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("classes", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("data", pa.binary())])
_segments_ddl = "bucket long, g long, classes binary, ids binary, counts binary, data binary"


def _send_segments(length: int, bits: int):
    """Distinct segments by bucket; with bucket -1 the places of every class for the block itself."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out, packer = [], zstandard.ZstdCompressor(level=3)  # smaller files and shuffles than Spark's own block compression gives
        shared = np.sort(np.concatenate([np.zeros(0, np.uint64), *[(np.uint64(b.as_py()) << np.uint64(32)) | np.frombuffer(k.as_py(), "<u4").astype(np.uint64) for b, k in zip(answers.column("bucket"), answers.column("keys"), strict=True)]]))
        for i in range(blocks.num_rows):
            g, ids, ends, data = (blocks.column(c)[i].as_py() for c in ("g", "ids", "ends", "data"))
            block = Block(ids, ends, data)
            at, n, keys, doc = block.runs(length)
            if not len(at):
                continue
            bucket = keys >> np.uint64(64 - bits)
            short = (bucket << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
            place = np.searchsorted(shared, short)
            hit = shared[np.minimum(place, len(shared) - 1)] == short if len(shared) else np.zeros(len(short), bool)
            # keys of two documents of this block
            order = np.argsort(keys, kind="stable")
            k, d = keys[order], doc[order]
            edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            many = np.minimum.reduceat(d, edge) != np.maximum.reduceat(d, edge)
            hit[order] |= np.repeat(many, np.diff(np.r_[edge, len(k)]))
            at, n, bucket, doc = at[hit], n[hit], bucket[hit], doc[hit]
            if not len(at):
                continue
            known: dict[bytes, int] = {}
            first: list[int] = []
            classes = np.empty(len(at), np.int32)
            for j, (s, e) in enumerate(zip(at.tolist(), (at + n + length - 1).tolist(), strict=True)):
                c = known.setdefault(data[s:e], len(known))
                classes[j] = c
                if c == len(first):
                    first.append(j)
            f = np.array(first)
            out.append((-1, g, classes.tobytes(), at.astype(np.int32).tobytes(), n.astype(np.uint8).tobytes(), b""))
            texts = list(known)
            by = np.argsort(bucket[f], kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[f][by])) + 1
            for some in np.split(by, cuts):
                j = f[some]
                out.append((int(bucket[j[0]]), g, classes[j].tobytes(), block.ids[doc[j]].tobytes(), n[j].astype(np.uint8).tobytes(), packer.compress(b"".join(texts[x] for x in some))))
        if not out:
            return _segments.empty_table()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _segments, strict=True)], schema=_segments)

    return run


# ------------------------------------------------- pass 3: sort one suffix bucket


def _words_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as numbers that compare like the bytes."""
    view = np.lib.stride_tricks.sliding_window_view(text, 8)[at]
    return np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)


def _dense(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """Ranks of the rows of keys (first key first); equal rows get equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def least_ids(text: np.ndarray, starts: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """The least id among the suffixes that agree with each one on ``length`` bytes.

    Sample ranks order the cover positions that suffixes reach within MODULUS - 1
    bytes. For a tie on the first and last eight bytes, each pair of suffixes has
    an offset at which both stand on sample positions; equal ranks there settle it.
    """
    text = np.r_[text, np.zeros(64, np.uint8)]
    depth = length - (MODULUS - 1)
    reach = np.zeros(len(text), bool)
    for d in range(MODULUS):
        reach[starts + d] = True
    in_cover = np.zeros(MODULUS, bool)
    in_cover[list(COVER)] = True
    sample = np.flatnonzero(reach & in_cover[np.arange(len(text)) % MODULUS])
    rank = np.zeros(len(text), np.int64)
    places = [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]
    rank[sample] = _dense(tuple(_words_at(text, sample + p) for p in places))
    ends = _dense((_words_at(text, starts), _words_at(text, starts + length - 8)))
    best = ids.copy()
    for d in range(MODULUS):
        at = np.flatnonzero(in_cover[(starts + d) % MODULUS])
        if not len(at):
            continue
        key = (ends[at] << 32) | rank[starts[at] + d]
        order = np.argsort(key)
        s = key[order]
        edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        low = np.repeat(np.minimum.reduceat(ids[at][order], edge), np.diff(np.r_[edge, len(s)]))
        best[at[order]] = np.minimum(best[at[order]], low)
    return best


_runs = pa.schema([("g", pa.int64()), ("classes", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
_runs_ddl = "g long, classes binary, low binary, high binary"


def _sort_bucket(length: int):
    def run(group: pa.Table) -> pa.Table:
        unpacker = zstandard.ZstdDecompressor()
        known: dict[bytes, int] = {}
        least: list[int] = []
        rows, kind = [], []
        for i in range(group.num_rows):
            g, classes, ids, counts, data = (group.column(c)[i].as_py() for c in ("g", "classes", "ids", "counts", "data"))
            classes, ids, counts = np.frombuffer(classes, np.int32), np.frombuffer(ids, np.int64), np.frombuffer(counts, np.uint8)
            data = unpacker.decompress(data)
            ends = np.cumsum(counts.astype(np.int64) + length - 1).tolist()
            mine = []
            for s, e, d in zip([0, *ends[:-1]], ends, ids.tolist(), strict=True):
                c = known.setdefault(data[s:e], len(known))
                if c == len(least):
                    least.append(d)
                elif d < least[c]:
                    least[c] = d
                mine.append(c)
            rows.append((g, classes, ids))
            kind.append(np.array(mine, np.int64))
        texts = list(known)
        sizes = np.array([len(t) for t in texts])
        n = sizes - length + 1
        base = np.cumsum(sizes) - sizes
        first = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(first, n)
        best = least_ids(np.frombuffer(b"".join(texts), np.uint8), np.repeat(base, n) + inner, np.repeat(np.array(least, np.int64), n), length)
        out = []
        for (g, classes, ids), mine in zip(rows, kind, strict=True):
            m = n[mine]
            own = np.repeat(np.arange(len(mine)), m)
            at = np.repeat(first[mine], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            gone = best[at] < ids[own]
            off = inner[at]
            begin = gone & np.r_[True, ~gone[:-1] | (own[1:] != own[:-1])]
            end = gone & np.r_[~gone[1:] | (own[1:] != own[:-1]), True]
            if begin.any():
                out.append((g, classes[own[begin]].tobytes(), off[begin].astype(np.uint8).tobytes(), (off[end] + 1).astype(np.uint8).tobytes()))
        if not out:
            return _runs.empty_table()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _runs, strict=True)], schema=_runs)

    return run


# ------------------------------------------------- pass 4: remove

_result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())])
_result_ddl = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"


def _remove(length: int):
    def run(blocks: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for i in range(blocks.num_rows):
            block = Block(*(blocks.column(c)[i].as_py() for c in ("ids", "ends", "data")))
            step = np.zeros(len(block.data) + 1, np.int32)
            places = [r for r in found.to_pylist() if r["at"] is not None]
            if places:
                classes, at, n = np.frombuffer(places[0]["classes"], np.int32), np.frombuffer(places[0]["at"], np.int32).astype(np.int64), np.frombuffer(places[0]["counts"], np.uint8).astype(np.int64)
                size = int(classes.max()) + 1
                doc = block.ids[np.searchsorted(block.ends, at, "right")]
                least = np.full(size, LAST_ID)
                np.minimum.at(least, classes, doc)
                later = doc > least[classes]  # an equal segment stands in an earlier document of this block
                np.add.at(step, at[later], 1)
                np.add.at(step, at[later] + n[later] + length - 1, -1)
                runs = [r for r in found.to_pylist() if r["low"] is not None]
                if runs:
                    c = np.concatenate([np.frombuffer(r["classes"], np.int32) for r in runs])
                    low = np.concatenate([np.frombuffer(r["low"], np.uint8) for r in runs]).astype(np.int64)
                    high = np.concatenate([np.frombuffer(r["high"], np.uint8) for r in runs]).astype(np.int64)
                    by = np.argsort(classes, kind="stable")
                    lo, hi = np.searchsorted(classes[by], c), np.searchsorted(classes[by], c, "right")
                    m = hi - lo
                    pick = by[np.repeat(lo, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)]
                    np.add.at(step, at[pick] + np.repeat(low, m), 1)
                    np.add.at(step, at[pick] + np.repeat(high, m) + length - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
            rise, fall = edge[::2], edge[1::2]
            for d, s, e in zip(block.ids.tolist(), block.starts.tolist(), block.ends.tolist(), strict=True):
                a, b = np.searchsorted(fall, s, "right"), np.searchsorted(rise, e, "left")
                spans = [(max(s, int(x)), min(e, int(y))) for x, y in zip(rise[a:b], fall[a:b], strict=True)]
                kept, p = [], s
                for x, y in spans:
                    kept.append(block.data[p:x])
                    p = y
                kept.append(block.data[p:e])
                out.append((None if d == LAST_ID else d, e - s, [x - s for x, _ in spans], [y - s for _, y in spans], b"".join(kept)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _result, strict=True)], schema=_result) if out else _result.empty_table()

    return run


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_bytes, starts and ends of the maximal removed runs, and the kept bytes of every row."""
    if not 48 <= length <= 180:
        raise ValueError("length must be between 48 and 180 bytes")
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.encode(F.col(f"`{text_col}`").cast("string"), "UTF-8").alias("text"))
    total = base.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    bits = max(3, min(31, int(n_blocks - 1).bit_length()))  # about as many buckets as blocks, so that a bucket does not grow with the corpus
    table = scratch_table(spark, "repeat_blocks")
    laid = base.mapInArrow(_lay(block_bytes), "g long, ids binary, ends binary, data binary")
    laid.write.option("compression", "zstd").bucketBy(max(8, min(100_000, n_blocks // 4)), "g").saveAsTable(table)
    blocks = spark.table(table)
    keys = blocks.mapInArrow(_send_keys(length, bits), "bucket long, g long, keys binary")
    answers = keys.groupBy("bucket").applyInArrow(_shared_keys, "g long, bucket long, keys binary")
    sent = write_cut(blocks.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_send_segments(length, bits), _segments_ddl), "segments")
    runs = sent.where("bucket >= 0").groupBy("bucket").applyInArrow(_sort_bucket(length), _runs_ddl)
    null = F.lit(None).cast("binary")
    places = sent.where("bucket = -1").select("g", "classes", F.col("ids").alias("at"), "counts", null.alias("low"), null.alias("high"))
    back = places.unionByName(runs.select("g", "classes", null.alias("at"), null.alias("counts"), "low", "high"))
    return spark.table(table).groupBy("g").cogroup(back.groupBy("g")).applyInArrow(_remove(length), _result_ddl)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, 50-byte matches."""
    got = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every 50-byte string written out as hex, in pieces of 500 starts.
SQL1 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, j, substr(h, 1000 * j + 1, 1098) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 1000 + 1)) AS j FROM d)),
w AS (SELECT doc_id, 500 * j + i AS i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, j, h, unnest(range(0, greatest(least(500, len(h) // 2 - 49), 0))) AS i FROM c)),
f AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
g AS (SELECT w.doc_id, w.i, CASE WHEN w.i - lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) <= 50 THEN 0 ELSE 1 END AS fresh FROM w JOIN f ON w.s = f.s WHERE f.first_id < w.doc_id),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM r),
z AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail FROM r GROUP BY doc_id),
k AS (SELECT q.doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head FROM q JOIN d ON q.doc_id = d.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN z.doc_id IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN z ON d.doc_id = z.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
