"""Simulated panels as native plans: a grid, one seeded draw per group key, labels by inverse CDF."""

from __future__ import annotations

from functools import reduce
from math import prod, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..spec import Design, SpecError
from . import votes


def grid(spark: SparkSession, levels: dict[str, int], max_rows: int = 10_000_000) -> DataFrame:
    """The complete grid of level numbers, first axis fastest, without any join."""
    rows = prod(levels.values())
    if rows > max_rows:
        raise SpecError("the simulated panel exceeds max_rows")
    out, repeat = spark.range(rows), 1
    for name, n in levels.items():
        out = out.withColumn(name, (F.floor(F.col("id") / repeat) % n + 1).cast("long"))
        repeat *= n
    return out.drop("id")


def gaussian_panel(spark: SparkSession, design: Design, levels: dict[str, int], components: dict[str, float], mean: float = 0.0, seed: int = 1, by: DataFrame | None = None) -> DataFrame:
    """The grid with ``y``: mean plus one seeded normal effect per source and group. Reruns give the same values."""
    base = grid(spark, levels)
    keys = []
    if by is not None:
        base, keys = base.crossJoin(F.broadcast(by)), [F.col(c) for c in by.columns]  # a bounded list of replications
    y = F.lit(float(mean))
    for i, (s, v) in enumerate(components.items()):
        members = design.variables if s == "Residual" else design.terms[s]
        y = y + sqrt(v) * N.normal(seed * 1000 + i, *keys, *[F.col(m) for m in members])
    return base.withColumn("y", y)


def ordinal_panel(panel: DataFrame, thresholds: list[float], levels: list[str], seed: int, keys: list[str]) -> DataFrame:
    """Labels of a cumulative logit on the latent ``y``."""
    p = N.ordinal_logit(F.col("y"), thresholds)
    u = N.uniform(seed + 31, *[F.col(k) for k in keys])
    return panel.withColumn("label", N.inverse_cdf_label(u, p, levels))


def joint_panel(spark: SparkSession, design: Design, levels: dict[str, int], components: dict, outcomes: list[str], means: dict[str, float] | None = None, seed: int = 1, max_rows: int = 1_000_000) -> DataFrame:
    """The grid with one column per outcome; a source's effects have its covariance matrix (by its eigenvalue root, so a singular one is allowed)."""
    import numpy as np

    base = grid(spark, levels, max_rows)
    total = {o: F.lit(float((means or {}).get(o, 0.0))) for o in outcomes}
    for i, (s, m) in enumerate(components.items()):
        members = design.variables if s == "Residual" else design.terms[s]
        values, vectors = np.linalg.eigh(np.asarray(m, float))
        if values[0] < -1e-8 * (1 + abs(values[-1])):
            raise SpecError(f"the matrix of {s} is not positive semidefinite")
        root = vectors * np.sqrt(np.clip(values, 0, None))
        draw = [N.normal(seed * 1000 + 50 * i + k, *[F.col(x) for x in members]) for k in range(len(outcomes))]
        for a, o in enumerate(outcomes):
            for k in range(len(outcomes)):
                if abs(root[a, k]) > 0:
                    total[o] = total[o] + float(root[a, k]) * draw[k]
    return base.withColumns(total)


def latent_pairs(spark: SparkSession, design: Design, levels: dict[str, int], components: dict[str, float], replications: int = 10, seed: int = 1) -> DataFrame:
    """replication, panel (1 or 2), the design columns and the latent ``y`` of pairs of panels that share their objects' effects only."""
    by = spark.range(1, replications + 1).withColumnRenamed("id", "replication").crossJoin(spark.createDataFrame([(1,), (2,)], "panel long"))
    base = grid(spark, levels).crossJoin(F.broadcast(by))  # replications x 2 rows
    y = F.lit(0.0)
    for i, (s, v) in enumerate(components.items()):
        if s == "Residual":
            continue
        shared = s == design.object
        y = y + sqrt(v) * N.normal(seed * 1000 + i, F.col("replication"), *([] if shared else [F.col("panel")]), *[F.col(m) for m in design.terms[s]])
    return base.withColumn("y", y)


def nominal_panel(panel: DataFrame, etas: list[str], levels: list[str], seed: int, keys: list[str]) -> DataFrame:
    """Labels of a softmax over the latent contrasts (the first level is the reference)."""
    p = N.softmax([F.lit(0.0), *[F.col(e) for e in etas]])
    return panel.withColumn("label", N.inverse_cdf_label(N.uniform(seed + 31, *[F.col(k) for k in keys]), p, levels))


def decision_target(spark: SparkSession, design: Design, levels: dict[str, int], components: dict[str, float], thresholds: list[float], labels: list[str], replications: int = 10, seed: int = 1) -> DataFrame:
    """Mean agreement of the pluralities of two panels that share their objects, with its Monte Carlo error."""
    drawn = ordinal_panel(latent_pairs(spark, design, levels, components, replications, seed), thresholds, labels, seed, ["replication", "panel", *levels])
    unit = F.struct("replication", F.col(design.object).alias("object"))
    a, b = (drawn.where(F.col("panel") == k).withColumn("unit", unit) for k in (1, 2))
    return votes.decision_agreement(a, b, "unit", "label")


def conditions(levels: dict[str, int]) -> int:
    return reduce(lambda a, b: a * b, levels.values(), 1)
