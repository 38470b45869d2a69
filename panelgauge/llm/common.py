"""Shared pieces of the training-data operators: scratch tables, word arrays, hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern [^\x20\x09-\x0D]+ (fixed values).
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same pattern for the JVM's regular expressions.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_OWN_DIR: list[str] = []
#: Scratch folders and tables that are still there.
_SCRATCH: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="panelgauge-"))
    return "file://" + _OWN_DIR[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is still there when the driver ends goes then."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH[path] = spark
    return path


def scratch_table(spark: SparkSession, name: str) -> str:
    """The name of a new table in the warehouse, dropped when the driver ends."""
    table = f"{name}_{uuid.uuid4().hex}"
    _SCRATCH[f"table:{table}"] = spark
    return table


def write_cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def release(*cuts: DataFrame) -> None:
    """Remove the files of cuts that nothing reads any more."""
    for df in cuts:
        drop_path(df.sparkSession, df._scratch_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _SCRATCH.pop(path, None)


def drop_scratch() -> None:
    """Remove all scratch folders and tables of this driver; their DataFrames can't be read any more."""
    for path, spark in list(_SCRATCH.items()):
        if spark.sparkContext._jsc is None:
            continue
        with contextlib.suppress(Exception):  # the driver is ending
            if path.startswith("table:"):
                spark.sql(f"DROP TABLE IF EXISTS {path[6:]}")
            else:
                drop_path(spark, path)
    _SCRATCH.clear()


atexit.register(drop_scratch)


#: Caches that workers keep between tasks. A worker serves many operators; one that needs the room empties the others' caches.
WORKER_CACHES: list[dict] = []


def give_back() -> None:
    """Freed memory goes back to the system: an idle worker otherwise holds it beside its executor's JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def release_caches() -> None:
    full = [cache for cache in WORKER_CACHES if cache]
    for cache in full:
        cache.clear()
    if full:
        give_back()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function, after which its worker keeps no cache and no freed memory."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_caches()
        give_back()

    return whole


# ---------------------------------------------------------------- hashing

_U = np.uint64
_rng = np.random.default_rng(20240817)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_GRAM = (_rng.integers(1, 2**63, 64, dtype=np.uint64) << _U(1)) | _U(1)
_pow = {"n": 0, "up": np.zeros(0, np.uint64), "down": np.zeros(0, np.uint64)}
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    with np.errstate(over="ignore"):
        x = x + _U((0x632BE59BD9B4E019 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        m = max(n, 2 * _pow["n"], 1 << 16)
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", _BASE_INV)):
                out = np.ones(m, np.uint64)
                done = 1
                while done < m:
                    step = min(done, m - done)
                    out[done : done + step] = out[:step] * _U(pow(base, done, 2**64))
                    done += step
                _pow[key] = out
        _pow["n"] = m
    return _pow["up"][:n], _pow["down"][:n]


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text's bytes."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.concatenate(([False], ~_IS_SPACE[b], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(text: str | bytes | None, lower: bool = False) -> np.ndarray:
    """A 64-bit hash for each word of the text, in order."""
    raw = b"" if text is None else text.encode() if isinstance(text, str) else text
    b = np.frombuffer(raw, np.uint8)
    starts, ends = word_spans(b)
    if not len(starts):
        return np.zeros(0, np.uint64)
    if lower:
        b = _LOWER[b]
    up, down = _powers(len(b) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * up[:-1], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows; of the whole sequence when it is shorter and has a word."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        if n < k:
            return mix((words * _GRAM[:n]).sum(dtype=np.uint64, keepdims=True), n)
        out = words[: n - k + 1] * _GRAM[0]
        for j in range(1, k):
            out = out + words[j : n - k + 1 + j] * _GRAM[j]
        return mix(out, k)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ------------------------------------------------- connected components


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v); component is the least node.

    Alternates large-star and small-star steps. Each step needs a minimum per
    node (combined before the shuffle) and one equi-join, so a node with very
    many neighbours is split like any skewed join. Nodes without edges do not
    occur in the result. Null ends and loops are dropped. The edges of each
    round are written to the shared folder, the former round is removed.
    """
    spark = edges.sparkSession
    big, small = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")

    def save(df: DataFrame) -> tuple[DataFrame, str, tuple[int, int]]:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        back = spark.read.schema("u long, v long").parquet(path)
        got = back.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        return back, path, (got[0], got[1] or 0)

    now, path, seen = save(edges.where("u <> v").select(big, small).distinct())
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").select(big, small).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        star = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        fresh = star.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after, new_path, mark = save(fresh)
        drop_path(spark, path)
        now, path = after, new_path
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("connected components did not converge")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
