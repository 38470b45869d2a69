"""Categorical targets: plurality votes, decision agreement, item moments, score ratios, replicate agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plurality_votes(panel: DataFrame, item: str, label: str) -> DataFrame:
    """item, label, votes, share: the categories with most votes share the decision equally."""
    n = panel.groupBy(item, label).agg(F.count("*").alias("votes"))
    most = n.withColumn("__top", F.max("votes").over(Window.partitionBy(item))).where("votes = __top").drop("__top")
    return most.withColumn("share", 1.0 / F.count("*").over(Window.partitionBy(item)))


def decision_agreement(left: DataFrame, right: DataFrame, item: str, label: str) -> DataFrame:
    """One row: the mean over items of the chance that two panels' pluralities agree, and the decision diversity."""
    a = plurality_votes(left, item, label).select(item, label, F.col("share").alias("l"))
    b = plurality_votes(right, item, label).select(item, label, F.col("share").alias("r"))
    items = left.select(item).distinct().join(right.select(item).distinct(), item).withColumn("__one", F.lit(1))
    same = a.join(b, [item, label]).groupBy(item).agg(F.sum(F.col("l") * F.col("r")).alias("agree"))
    one = items.join(same, item, "left").agg(F.avg(F.coalesce("agree", F.lit(0.0))).alias("agreement"), F.count("*").alias("items"))
    both = a.select(item, label, F.col("l").alias("s")).unionByName(b.select(item, label, F.col("r").alias("s"))).join(items.select(item), item, "left_semi")
    shares = both.groupBy(label).agg(F.sum("s").alias("s")).crossJoin(F.broadcast(one)).agg((1 - F.sum(F.pow(F.col("s") / (2 * F.col("items")), 2))).alias("decision_diversity"))
    return one.crossJoin(F.broadcast(shares))  # one row each


def probability_variance(probabilities: list[Column], scores: list[float] | None = None) -> Column:
    """Within-row variance of the category indicator vector, or of the score, without cancelling differences."""
    if scores is None:
        out, before = F.lit(0.0), F.lit(0.0)
        for p in probabilities:
            out, before = out + 2 * p * before, before + p
        return out
    mean = reduce(lambda a, b: a + b, [p * s for p, s in zip(probabilities, scores, strict=True)])
    return reduce(lambda a, b: a + b, [p * (F.lit(s) - mean) * (F.lit(s) - mean) for p, s in zip(probabilities, scores, strict=True)])


def item_moments(rows: DataFrame, item: str, probabilities: list[str], scores: list[float] | None = None) -> DataFrame:
    """item, mean (per category, or of the score), second: squared mean plus the averaged within-row variance."""
    p = [F.col(c) for c in probabilities]
    noise = (F.sum(probability_variance(p, scores)) / (F.count("*") * F.count("*"))).alias("noise")
    if scores is None:
        g = rows.groupBy(item).agg(*[F.avg(c).alias(c) for c in probabilities], noise)
        return g.withColumn("second", reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in probabilities]) + F.col("noise")).drop("noise")
    mean = reduce(lambda a, b: a + b, [x * s for x, s in zip(p, scores, strict=True)])
    g = rows.groupBy(item).agg(F.avg(mean).alias("mean"), noise)
    return g.withColumn("second", F.col("mean") * F.col("mean") + F.col("noise")).drop("noise")


def score_ratio(left: DataFrame, right: DataFrame, item: str) -> DataFrame:
    """One row: signal, total, raw ratio, delta standard error from two panels' item moments (mean, second)."""
    m = left.select(item, F.col("mean").alias("l"), F.col("second").alias("sl")).join(right.select(item, F.col("mean").alias("r"), F.col("second").alias("sr")), item)
    m = m.select("l", "r", (F.col("l") * F.col("r")).alias("c"), ((F.col("sl") + F.col("sr")) / 2).alias("s"))
    a = m.agg(*[F.avg(x).alias(f"m{x}") for x in ("l", "r", "c", "s")])
    mid = (F.col("ml") + F.col("mr")) / 2
    a = a.withColumns({"signal": F.col("mc") - F.col("ml") * F.col("mr"), "total": F.col("ms") - mid * mid, "mid": mid})
    rows = m.crossJoin(F.broadcast(a))  # one row
    t, sig = F.col("total"), F.col("signal")
    g = lambda gs, gt: (F.lit(1.0) * gs * t - sig * gt) / (t * t)
    influence = F.col("l") * g(-F.col("mr"), -F.col("mid")) + F.col("r") * g(-F.col("ml"), -F.col("mid")) + F.col("c") * g(F.lit(1.0), F.lit(0.0)) + F.col("s") * g(F.lit(0.0), F.lit(1.0))
    return rows.withColumn("i", influence).agg(F.first("signal").alias("signal_variance"), F.first("total").alias("total_variance"), (F.first("signal") / F.first("total")).alias("raw_estimate"), F.sqrt(F.var_samp("i") / F.count("*")).alias("mc_se"))


def vector_ratio(left: DataFrame, right: DataFrame, item: str, categories: list[str]) -> DataFrame:
    """One row: signal, total and raw ratio of the vector of category probabilities, with a delta standard error, from two panels' item moments.

    Signal: the sum over categories of the covariance of both panels' means; total: the mean second moment less the squared mean vector.
    """
    m = left.select(item, *[F.col(c).alias(f"l_{c}") for c in categories], F.col("second").alias("sl")).join(right.select(item, *[F.col(c).alias(f"r_{c}") for c in categories], F.col("second").alias("sr")), item)
    dot = reduce(lambda a, b: a + b, [F.col(f"l_{c}") * F.col(f"r_{c}") for c in categories])
    m = m.withColumns({"c": dot, "s": (F.col("sl") + F.col("sr")) / 2})
    a = m.agg(*[F.avg(f"{k}_{c}").alias(f"m{k}_{c}") for k in "lr" for c in categories], F.avg("c").alias("mc"), F.avg("s").alias("ms"))
    mid = {c: (F.col(f"ml_{c}") + F.col(f"mr_{c}")) / 2 for c in categories}
    add = lambda parts: reduce(lambda x, y: x + y, parts)
    a = a.withColumns({"signal": F.col("mc") - add([F.col(f"ml_{c}") * F.col(f"mr_{c}") for c in categories]), "total": F.col("ms") - add([mid[c] * mid[c] for c in categories])})
    rows = m.crossJoin(F.broadcast(a))  # one row
    t, sig = F.col("total"), F.col("signal")
    g = lambda gs, gt: (F.lit(1.0) * gs * t - sig * gt) / (t * t)
    influence = add([F.col(f"l_{c}") * g(-F.col(f"mr_{c}"), -mid[c]) + F.col(f"r_{c}") * g(-F.col(f"ml_{c}"), -mid[c]) for c in categories]) + F.col("c") * g(F.lit(1.0), F.lit(0.0)) + F.col("s") * g(F.lit(0.0), F.lit(1.0))
    return rows.withColumn("i", influence).agg(F.first("signal").alias("signal_variance"), F.first("total").alias("total_variance"), (F.first("signal") / F.first("total")).alias("raw_estimate"), F.sqrt(F.var_samp("i") / F.count("*")).alias("mc_se"))


def replicate_agreement(panel: DataFrame, cell: list[str], condition: str, label: str) -> DataFrame:
    """condition, cells, agreement: the share of cells whose replicates all carry one label."""
    g = panel.groupBy(*cell, condition).agg(F.count_distinct(label).alias("d"))
    return g.groupBy(condition).agg(F.count("*").alias("cells"), F.avg((F.col("d") == 1).cast("double")).alias("agreement"))
