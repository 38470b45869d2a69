"""Bounded-space online packing of token ids.

Each partition keeps ``open_windows`` open windows. A document is cut into full
windows and a rest; the rest goes to the open window with the least room that
holds it (best fit). When none holds it, the fullest window is topped up with
the head of the rest and emitted. What stays open at the end of a partition is
merged over ever fewer partitions by the same rule; the last merge cuts its open
windows into sequences whose lengths are powers of two, which need no padding.

Defined results
  null or empty text   the end id alone
  null ids, repeated rows   each row is a document of its own
  very long text       streamed window by window
  empty table          no pieces
  other columns        ignored
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidy, write_cut
from .tokens import CACHE_PARTS, default_vocabulary, encoder, with_end

_out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("level", pa.int32()), ("ids", pa.binary())])
_ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, level int, ids binary"


class Windows:
    """Open windows of one partition; pieces are (doc_id, start, doc_tokens, id bytes)."""

    def __init__(self, size: int, open_windows: int, first_id: int, level: int):
        self.size, self.most, self.next_id, self.level = size, open_windows, first_id, level
        self.open: list[list] = []  # [tokens, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at, self.level, None))
            at += n
        self.next_id += 1

    def add(self, doc, start: int, total: int, ids: bytes) -> None:
        full = 4 * self.size
        while len(ids) >= full:
            self.emit([(doc, start, total, ids[:full])])
            ids, start = ids[full:], start + self.size
        while ids:
            n = len(ids) // 4
            fits = [w for w in self.open if w[0] + n <= self.size]
            if fits:
                w = max(fits, key=lambda x: x[0])
            elif len(self.open) < self.most:
                w = [0, []]
                self.open.append(w)
            else:
                w = max(self.open, key=lambda x: x[0])
            take = min(n, self.size - w[0])
            w[1].append((doc, start, total, ids[: 4 * take]))
            w[0] += take
            ids, start = ids[4 * take :], start + take
            if w[0] == self.size:
                self.emit(w[1])
                self.open = [x for x in self.open if x is not w]

    def leave(self) -> None:
        """Hand the open pieces to the next level."""
        for _, pieces in self.open:
            for doc, start, total, ids in pieces:
                self.rows.append((doc, start, len(ids) // 4, 0, total, None, None, self.level, ids))
        self.open = []

    def close(self) -> None:
        """Cut what is open into sequences whose lengths are powers of two."""
        for tokens, pieces in self.open:
            left = [list(p) for p in pieces]
            for bit in range(tokens.bit_length() - 1, -1, -1):
                want = tokens & (1 << bit)
                some = []
                while want:
                    doc, start, total, ids = left[0]
                    n = min(want, len(ids) // 4)
                    some.append((doc, start, total, ids[: 4 * n]))
                    left[0] = [doc, start + n, total, ids[4 * n :]]
                    if not left[0][3]:
                        left.pop(0)
                    want -= n
                if some:
                    self.emit(some)
        self.open = []

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _out, strict=True)], schema=_out)


def _first_id(level: int) -> int:
    return (level << 56) | (TaskContext.get().partitionId() << 32)


def _pack(vocabulary: str, end_id: int, size: int, open_windows: int, cache_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, cache_parts)
        w = Windows(size, open_windows, _first_id(0), 0)
        for b in batches:
            docs = b.column(0).to_pylist()
            for at, end, ids, bounds in enc.stream(b.column(1)):
                ids, bounds = with_end(ids, bounds, end_id)
                raw, cuts = ids.astype("<u4", copy=False).tobytes(), (4 * bounds).tolist()
                for doc, x, y in zip(docs[at:end], cuts, cuts[1:], strict=False):
                    w.add(doc, 0, (y - x) // 4, raw[x:y])
                if w.rows:
                    yield w.take()
        w.leave()
        if w.rows:
            yield w.take()

    return run


def _merge(size: int, open_windows: int, level: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows(size, open_windows, _first_id(level), level)
        for b in batches:
            for r in b.to_pylist():
                w.add(r["doc_id"], r["start"], r["doc_tokens"], r["ids"])
        w.close() if last else w.leave()
        if w.rows:
            yield w.take()

    return run


def pack(docs: DataFrame, size: int = 2048, open_windows: int = 16, vocabulary: str | None = None, end_id: int = 1, fan_in: int = 64, cache_parts: int = CACHE_PARTS, keep_cache: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A task carries at most ``open_windows`` windows; a merge task reads at most
    ``fan_in`` times as many. ``cache_parts``: encoded words that a worker keeps, until its task ends
    if not ``keep_cache`` (memory only).
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    packed = _pack(vocabulary or default_vocabulary(), end_id, size, open_windows, cache_parts)
    stage = write_cut(base.mapInArrow(packed if keep_cache else tidy(packed), _ddl).withColumn("part", F.spark_partition_id()), "packed")
    done = [stage.where("ids IS NULL")]
    rest = stage.where("ids IS NOT NULL")
    parts = (stage.agg(F.max("part")).first()[0] or 0) + 1
    level = 0
    while True:
        level += 1
        groups = -(-parts // fan_in)
        dealt = rest.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).repartitionByRange(groups, "part").sortWithinPartitions("part", "doc_id", "start")
        merged = write_cut(dealt.select(*_out.names).mapInArrow(_merge(size, open_windows, level, groups == 1), _ddl).withColumn("part", F.spark_partition_id()), "packed")
        done.append(merged.where("ids IS NULL"))
        if groups == 1:
            break
        rest, parts = merged.where("ids IS NOT NULL"), groups
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
