"""Content-addressed store of token ids.

Ids are written in 2 bytes where the vocabulary has at most 65,536 ids, else in
4; an id that does not fit is refused. A rolling hash over the last ``WINDOW``
ids cuts each document's stream into chunks, so equal passages give equal chunks
wherever they stand. A chunk's address is its SHA-256. Under the store's path are

  chunks     each distinct chunk once, under its address
  recipes    per document, in files of ascending doc_id, the addresses and lengths
             of its chunks, their Merkle root, and its place in its file's stream
  manifests  per recipe file its documents, tokens, place in the whole stream and
             the Merkle root over its recipes' roots

Reading verifies each chunk against its address, each recipe against its root and
each file's recipes against their manifest.

Defined results
  null or empty text   the end id alone
  null id              ranks after all others; repeated ids and equal texts keep a row each
  very long text       chunks have at most ``MAX_IDS`` ids, so no stored value grows with a text, save the recipe
  empty table          an empty store
  other columns        ignored, whatever their names
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_path, scratch_path
from .tokens import default_vocabulary, encoder, with_end

WINDOW, MIN_IDS, MEAN_IDS, MAX_IDS = 16, 128, 1024, 8192
_MULT = 0x9E3779B1
_FEW = 1 << 18
_staged = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("seq", pa.int32()), ("digest", pa.binary()), ("n", pa.int32()), ("ids", pa.binary()), ("lengths", pa.list_(pa.int32()))])


def rolling_marks(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end: where the hash of the last WINDOW ids is 0 modulo MEAN_IDS."""
    with np.errstate(over="ignore"):
        h, span, factor = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA77), 1, _MULT
        while span < WINDOW:  # h[i] covers the last span ids; two neighbouring spans make one of twice the length
            h[span:] = h[span:] + h[:-span] * np.uint32(factor)
            span, factor = 2 * span, factor * factor % 2**32
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE3D)
    return np.flatnonzero((h >> np.uint32(20)) % np.uint32(MEAN_IDS) == 0) + 1


def chunk_ends(marks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends of all chunks, chunks of each document); the documents lie on end within ``bounds``.

    A chunk ends at the first mark after at least MIN_IDS ids, at MAX_IDS, or with
    its document. Marks near a document's start also cover the one before it, but
    they are below MIN_IDS and never used.
    """
    first, last = np.searchsorted(marks, bounds[:-1] + MIN_IDS), np.searchsorted(marks, bounds[1:], "left")
    plain = (first >= last) & (np.diff(bounds) <= MAX_IDS)
    ends: list[int] = []
    counts = np.ones(len(bounds) - 1, np.int64)
    done = 0
    for i in np.flatnonzero(~plain).tolist():
        ends += bounds[done + 1 : i + 1].tolist()
        done = i + 1
        start, stop, before = int(bounds[i]), int(bounds[i + 1]), len(ends)
        for m in [*marks[first[i] : last[i]].tolist(), stop]:
            while m - start > MAX_IDS:
                start += MAX_IDS
                ends.append(start)
            if m - start >= MIN_IDS or m == stop:
                ends.append(m)
                start = m
        counts[i] = len(ends) - before
    ends += bounds[done + 1 :].tolist()
    return np.array(ends, np.int64), counts


def merkle_root(digests: list[bytes]) -> bytes:
    """SHA-256 over pairs, level by level; an odd last node moves up."""
    level = list(digests)
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


def _slices(data: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of neighbouring pieces of data, without a copy of them."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(data)])


def _encode(vocabulary: str, end_id: int, width: int):
    """Per document a row with the addresses (``digest``: 32 bytes each) and lengths of its chunks; a row with the ids of each chunk not sent lately."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        if max(enc.n_ids - 1, end_id) >= 1 << 8 * width:
            raise ValueError(f"ids up to {max(enc.n_ids - 1, end_id)} do not fit in {width} bytes")
        sent: set[bytes] = set()
        for batch in batches:
            for at, end, ids, bounds in enc.stream(batch.column(2)):
                ids, bounds = with_end(ids, bounds, end_id)
                ends, counts = chunk_ends(rolling_marks(ids), bounds)
                data = memoryview(ids.astype(f"<u{width}")).cast("B")
                cuts = (ends * width).tolist()
                digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
                lengths = np.diff(np.r_[0, ends]).astype(np.int32)
                docs, last = batch.slice(at, end - at), np.cumsum(counts)
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [docs.column(0), docs.column(1), pa.nulls(n, pa.int32()), _slices(b"".join(digests), 32 * last), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.ListArray.from_arrays(pa.array(np.r_[0, last], pa.int32()), pa.array(lengths))],
                    schema=_staged,
                )
                if len(sent) > _FEW:
                    sent.clear()
                new = []
                for i, d in enumerate(digests):
                    if d not in sent:
                        sent.add(d)
                        new.append(i)
                if new:
                    rows = pa.array(np.repeat(np.arange(n), counts)[new])
                    seq = np.arange(len(ends)) - np.repeat(last - counts, counts)
                    bodies = _slices(data, np.array(cuts, np.int64)).take(pa.array(new))
                    yield pa.RecordBatch.from_arrays(
                        [docs.column(0).take(rows), docs.column(1).take(rows), pa.array(seq[new], pa.int32()), _slices(b"".join(digests), 32 * np.arange(1, len(ends) + 1)).take(pa.array(new)), pa.array(lengths[new]), bodies, pa.nulls(len(new), pa.list_(pa.int32()))],
                        schema=_staged,
                    )

    return run


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's recipes with their roots and places in the partition's stream."""
    at = 0
    for b in batches:
        counts = b.column("n_tokens").to_numpy()
        roots = [merkle_root([d[i : i + 32] for i in range(0, len(d), 32)]) for d in b.column("digests").to_pylist()]
        yield b.append_column("root", pa.array(roots, pa.binary())).append_column("place", pa.array(at + np.cumsum(counts) - counts, pa.int64()))
        at += int(counts.sum())


_recipe_ddl = "doc_id long, row_key long, digests binary, lengths array<int>, n_tokens long, root binary, place long"


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs and write ``chunks``, ``recipes`` and ``manifests`` under path. ``width``: bytes of a stored id (2 for up to 65,536 ids, else 4)."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    staged = f"{path}/staged"
    # row_key tells rows apart that share an id; it only has to be unique within this write
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ddl = "doc_id long, row_key long, seq int, digest binary, n int, ids binary, lengths array<int>"
    base.mapInArrow(_encode(vocabulary, end_id, width), ddl).write.option("compression", "zstd").parquet(staged)
    rows = spark.read.schema(ddl).parquet(staged)
    # the owner of a chunk is its first occurrence; only addresses and keys are shuffled to find it
    bodies = rows.where("seq IS NOT NULL")
    owners = bodies.groupBy("digest").agg(F.min(F.struct("row_key", "seq")).alias("at")).select("at.row_key", "at.seq")
    bodies.join(owners, ["row_key", "seq"], "left_semi").select("digest", "n", "ids").write.option("compression", "zstd").parquet(f"{path}/chunks")
    by_id = F.col("doc_id").asc_nulls_last(), F.col("row_key")
    recipe = rows.where("seq IS NULL").select("doc_id", "row_key", F.col("digest").alias("digests"), "lengths", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"))
    # ascending doc_id over range partitions: one file per partition, each in order
    ordered = recipe.repartitionByRange(*by_id).sortWithinPartitions(*by_id).mapInArrow(_recipes, _recipe_ddl)
    ordered.withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{path}/recipes")
    drop_path(spark, staged)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per recipe file
    _manifests(read_recipes(spark, path)).withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/manifests")


def _manifests(recipes: DataFrame) -> DataFrame:
    """part, n_docs, n_tokens and the hash of the roots in order: one row per recipe file; a file's roots are as many as a partition has documents."""
    roots = F.transform(F.array_sort(F.collect_list(F.struct("place", "row_key", "root"))), lambda x: F.hex(x["root"]))
    return recipes.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sha2(F.array_join(roots, ""), 256).alias("root"))


# ------------------------------------------------- reading


def _checked(with_ids: bool):
    out = pa.schema([("digest", pa.binary()), ("n", pa.int32()), ("crc", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, bodies, sizes = (b.column(c).to_pylist() for c in ("digest", "ids", "n"))
            crcs, counts, wide = [], [], []
            for d, body, n in zip(digests, bodies, sizes, strict=True):
                if hashlib.sha256(body).digest() != d:
                    raise ValueError(f"chunk {d.hex()} does not match its address")
                ids = np.frombuffer(body, f"<u{len(body) // n}").astype("<u4").tobytes()
                crcs.append(zlib.crc32(ids))
                counts.append(len(ids) // 4)
                if with_ids:
                    wide.append(ids)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int32()), pa.array(crcs, pa.int64()), *([pa.array(wide, pa.binary())] if with_ids else [])], schema=out)

    return run


def read_chunks(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """digest, n, crc and ids (little-endian uint32 bytes) of every stored chunk, verified against its address."""
    stored = spark.read.schema("digest binary, n int, ids binary").parquet(f"{path}/chunks")
    return stored.mapInArrow(_checked(with_ids), "digest binary, n int, crc long" + ", ids binary" * with_ids)


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_recipe_ddl}, part int").parquet(f"{path}/recipes")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """part and start of every recipe file, verified against the recipes' roots."""
    said = spark.read.schema("part int, n_docs long, n_tokens long, root string, start long").parquet(f"{path}/manifests")
    found = _manifests(read_recipes(spark, path)).select("part", *[F.col(c).alias(f"found_{c}") for c in ("n_docs", "n_tokens", "root")])
    same = F.coalesce((F.col("n_docs") == F.col("found_n_docs")) & (F.col("n_tokens") == F.col("found_n_tokens")) & (F.col("root") == F.col("found_root")), F.lit(False))
    checked = F.when(same, F.col("start")).otherwise(F.raise_error(F.concat(F.lit("recipes do not match their manifest: part "), F.col("part"))).cast("long"))
    return said.join(found, "part", "full").select("part", checked.alias("before"))


_POLY = 0xEDB88320


def _operators(bits: int = 48) -> np.ndarray:
    """[k, j]: crc bit j after 2**k zero bytes (the GF(2) matrix of CRC-32)."""
    def times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for j in range(32):
            out ^= np.where((v >> np.uint32(j)) & np.uint32(1), m[j], np.uint32(0))
        return out

    one_bit = np.array([_POLY, *[1 << j for j in range(31)]], np.uint32)
    m = one_bit
    for _ in range(3):
        m = times(m, m)
    ops = [m]
    for _ in range(bits - 1):
        ops.append(times(ops[-1], ops[-1]))
    return np.array(ops)


_ops: list[np.ndarray] = []


def crc_join(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of a concatenation from the CRC-32 of its halves."""
    if not _ops:
        _ops.extend(_operators().tolist())
    k = 0
    while second_bytes:
        if second_bytes & 1:
            m, v, j = _ops[k], 0, 0
            while first:
                if first & 1:
                    v ^= m[j]
                first >>= 1
                j += 1
            first = v
        second_bytes >>= 1
        k += 1
    return first ^ second


def _recipe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crcs = []
        for root, n, parts in zip(b.column("root").to_pylist(), b.column("n_tokens").to_pylist(), b.column("parts").to_pylist(), strict=True):
            if merkle_root([p["digest"] for p in parts]) != root or sum(p["n"] or 0 for p in parts) != n:
                raise ValueError("recipe does not match its Merkle root, or a chunk is missing")
            crc = parts[0]["crc"]
            for p in parts[1:]:
                crc = crc_join(crc, p["crc"], 4 * p["n"])
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _parts(spark: SparkSession, path: str, chunks: DataFrame, *extra: str) -> DataFrame:
    """Recipes joined with what the chunks give, one row per document, parts in order."""
    recipes = read_recipes(spark, path).join(read_manifests(spark, path), "part")
    each = F.transform("lengths", lambda n, i: F.struct(i.alias("seq"), F.col("digests").substr(i * 32 + 1, F.lit(32)).alias("digest")))
    steps = recipes.select("doc_id", "row_key", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "root", F.inline(each))
    joined = steps.join(chunks, "digest", "left")
    return joined.groupBy("doc_id", "row_key", "start", "n_tokens", "root").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "n", *extra))).alias("parts"))


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the stored files; only checksums of the verified chunks are moved."""
    chunks = read_chunks(spark, path, False)
    return _parts(spark, path, chunks, "crc").mapInArrow(_recipe_rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array) of every document, put together again from its chunks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for root, n, parts in zip(b.column("root").to_pylist(), b.column("n_tokens").to_pylist(), b.column("parts").to_pylist(), strict=True):
                whole = b"".join(p["ids"] or b"" for p in parts)
                if merkle_root([p["digest"] for p in parts]) != root or len(whole) != 4 * n:
                    raise ValueError("recipe does not match its Merkle root, or a chunk is missing")
                ids.append(np.frombuffer(whole, "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return _parts(spark, path, read_chunks(spark, path), "ids").mapInArrow(whole, "doc_id long, start long, ids array<int>")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the store and back."""
    path = scratch_path(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return verify_store(spark, path)
