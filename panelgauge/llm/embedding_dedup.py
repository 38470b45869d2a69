"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised and projected on seeded Gaussian directions; a key is the
tuple of ``hashes`` projections, shifted and cut into steps of ``width``. Each of
``tables`` tables has its own key. Vectors that share a key in a table are
compared exactly in double precision; a pair is counted only in the first table
where it shares a key, so every found pair counts once.

Equal vectors are collapsed into one class with a weight before hashing. A
bucket is split into blocks of about ``block`` classes; each pair of blocks is a
task group of its own, so no bucket lands in one task. A group returns link
counts and a spanning set of its links, never its pairs.

The number of hashes grows with the logarithm of the number of vectors, so that about
``crowd`` unrelated vectors share a bucket at any size; the number of tables follows so
that a pair at the threshold shares a key with probability 1 - ``miss``.

Recall: 6 hashes and 32 tables (up to 64,000 vectors): 99.8 % of 20,000 random pairs at cosine 0.95
shared a key, 99.98 % at 0.97. Pairs below the threshold are never linked.

Defined results
  null or zero vectors, null or non-finite components   linked with nothing
  vectors of another length   compared with vectors of their own length only
  repeated rows, equal ids    equal vectors link with each other; rows with the same id are separate vectors
  null id                     counts as a vector, its component is the least non-null id reached, else null
  empty table                 no rows
  other columns               ignored
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, write_cut


def same_cell(distance: float, width: float) -> float:
    """Chance that a random projection puts two vectors at that distance into one step."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_plan(n: int, threshold: float, width: float, crowd: float = 25.0, miss: float = 0.0025) -> tuple[int, int]:
    """(hashes, tables) for so many vectors; unrelated unit vectors are about the root of 2 apart."""
    near, far = same_cell(math.sqrt(2 - 2 * threshold), width), same_cell(math.sqrt(2), width)
    hashes = max(6, math.ceil(math.log(max(n, 1) / crowd) / -math.log(far)))
    return hashes, math.ceil(math.log(miss) / math.log1p(-(near**hashes)))


def projections(dim: int, tables: int, hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * hashes)), rng.random(tables * hashes)


def table_keys(unit: np.ndarray, tables: int, hashes: int, width: float, seed: int) -> np.ndarray:
    """One 64-bit key per row and table."""
    a, shift = projections(unit.shape[1], tables, hashes, seed)
    cell = np.floor(unit @ a / width + shift).astype(np.int64).view(np.uint64).reshape(len(unit), tables, hashes)
    key = np.full((len(unit), tables), np.uint64(unit.shape[1]))
    with np.errstate(over="ignore"):
        for j in range(hashes):
            key = (key ^ cell[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def unit_rows(vectors: list) -> dict[int, tuple[list[int], np.ndarray]]:
    """length -> (positions, unit vectors) of the usable vectors."""
    by: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, v in enumerate(vectors):
        if v is None or not len(v) or any(x is None for x in v):
            continue
        x = np.asarray(v, np.float64)
        top = np.abs(x).max()
        if not np.isfinite(x).all() or top == 0:
            continue
        x = x / top
        by.setdefault(len(x), []).append((i, x / np.sqrt((x * x).sum())))
    return {n: ([i for i, _ in rows], np.stack([x for _, x in rows])) for n, rows in by.items()}


def _hash(tables: int, hashes: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(1).to_pylist()
            for _, (at, unit) in unit_rows(vectors).items():
                keys = table_keys(unit, tables, hashes, width, seed)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([x.tobytes() for x in unit], pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int64()))], names=["vec_id", "unit", "keys"])

    return run


_found = pa.schema([("class_id", pa.int64()), ("linked", pa.int64()), ("other", pa.int64())])


def compare_bucket(ids, unit, keys, weight, side, within: bool, table: int, threshold: float):
    """(linked weight, least index of its spanning tree) of each row of one bucket or pair of blocks; rows ascend by id."""
    n = len(ids)
    linked, label = np.zeros(n, np.int64), np.arange(n)
    a, b = (np.arange(n),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for at in range(0, len(a), 256):
        rows = a[at : at + 256]
        x, y = np.nonzero(unit[rows] @ unit[b].T >= threshold - 1e-9)
        p, q = rows[x], b[y]
        ok = p != q
        if within:
            ok &= p < q
        p, q = p[ok], q[ok]
        if not len(p):
            continue
        ok = (unit[p] * unit[q]).sum(1) >= threshold
        if table:
            ok &= ~(keys[p, :table] == keys[q, :table]).any(1)
        p, q = p[ok], q[ok]
        linked += np.bincount(p, weight[q], n).astype(np.int64) + np.bincount(q, weight[p], n).astype(np.int64)
        cuts = np.flatnonzero(np.diff(p)) + 1
        for r, near in zip(p[np.r_[0, cuts]] if len(p) else [], np.split(q, cuts), strict=True) if len(p) else ():
            seen = label[near]
            if (seen != label[r]).any():
                join = np.unique(np.r_[seen, label[r]])
                label[np.isin(label, join)] = join[0]
    return linked, label


def _compare(threshold: float, tables: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("t", "ascending"), ("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("class_id", "ascending")])
        ids = group.column("class_id").to_numpy()
        keys = np.array(group.column("keys").to_pylist(), np.int64).reshape(-1, tables)
        weight = group.column("weight").to_numpy()
        cols = [group.column(c).to_numpy() for c in ("t", "key", "i", "j")]
        side, raw = group.column("side").to_numpy(), group.column("unit").to_pylist()
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        out_id, out_n, out_o = [], [], []
        for s, e in zip(np.r_[0, edge], np.r_[edge, len(ids)], strict=True):
            if e - s < 2 or len({len(x) for x in raw[s:e]}) > 1:
                continue
            unit = np.frombuffer(b"".join(raw[s:e]), np.float64).reshape(e - s, -1)
            linked, label = compare_bucket(ids[s:e], unit, keys[s:e], weight[s:e], side[s:e], cols[2][s] == cols[3][s], int(cols[0][s]), threshold)
            hit = np.flatnonzero(linked)
            out_id.append(ids[s:e][hit])
            out_n.append(linked[hit])
            out_o.append(ids[s:e][label[hit]])
        if not out_id:
            return _found.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in (out_id, out_n, out_o)], schema=_found)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", width: float = 1.0, hashes: int | None = None, tables: int | None = None, seed: int = 7, block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id for every row. ``hashes`` and ``tables`` follow from the number of vectors where they are not given."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    planned = table_plan(vectors.count(), threshold, width) if hashes is None or tables is None else (0, 0)
    hashes, tables = hashes or planned[0], tables or planned[1]
    base = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    hashed = base.mapInArrow(_hash(tables, hashes, width, seed), "vec_id long, unit binary, keys array<long>")
    rows = write_cut(hashed.withColumn("row_key", F.monotonically_increasing_id()), "vectors")
    # equal vectors are one class: its first row stands for it, its size is its weight
    classes = write_cut(rows.groupBy("unit").agg(F.min("row_key").alias("class_id"), F.count("*").alias("weight"), F.first("keys").alias("keys")), "classes")
    light = classes.select("class_id", F.posexplode("keys").alias("t", "key"))
    crowd = light.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("class_id"), F.col("nb")).cast("int")
    placed = light.join(crowd, ["t", "key"]).withColumn("nb", blocks).withColumn("own", mine)
    pair = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j"), (x < F.col("own")).cast("int").alias("side")))
    dealt = placed.select("class_id", "t", "key", F.explode(pair).alias("p")).select("class_id", "t", "key", "p.i", "p.j", "p.side")
    groups = max(1, rows.count() * tables // 4096)
    full = dealt.join(classes, "class_id").withColumn("g", F.pmod(F.xxhash64("t", "key", "i", "j"), F.lit(groups)))
    found = write_cut(full.groupBy("g").applyInArrow(_compare(threshold, tables), "class_id long, linked long, other long"), "found")
    links = found.groupBy("class_id").agg(F.sum("linked").alias("linked"))
    parts = connected_components(found.select(F.col("class_id").alias("u"), F.col("other").alias("v")), "embedding-cc")
    known = classes.select("class_id", "unit", "weight").join(links, "class_id", "left").join(parts.withColumnRenamed("node", "class_id"), "class_id", "left")
    known = known.select("unit", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component"))
    member = write_cut(rows.select("vec_id", "unit").join(known, "unit").select("vec_id", "n_links", "component"), "members")
    least = write_cut(member.groupBy("component").agg(F.min("vec_id").alias("component_id")), "least")  # plain exchanges on both sides below
    linked = member.join(least, "component").select("vec_id", "n_links", "component_id")
    # unusable rows have no unit vector: each links with nothing
    usable = F.coalesce(F.size("vector"), F.lit(0)) > 0
    usable &= F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    alone = base.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whatever their labels."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: All pairs; hashing finds fewer only if a pair shares no key (see Recall).
SQL8 = r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
l AS (SELECT x AS u, y AS v FROM p UNION ALL SELECT y, x FROM p),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u),
r AS (SELECT vec_id, vec_id AS reach FROM embeddings UNION SELECT r.vec_id, l.v FROM r JOIN l ON r.reach = l.u)
SELECT r.vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(reach) AS component_id, r.vec_id = min(reach) AS kept
FROM r LEFT JOIN n ON r.vec_id = n.u GROUP BY r.vec_id
"""
