"""Sums of squares and products of all 2^k strata, moment components, deviance.

The strata of a balanced panel are the grouping sets of its axes: one CUBE of
cell sums on centred outcomes gives every marginal mean, and inclusion and
exclusion over the subsets of a stratum gives its sums of products. After the
CUBE the tables have at most 4^k rows, whatever the panel's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def centred(panel: DataFrame, outcomes: list[str]) -> DataFrame:
    means = panel.agg(*[F.avg(o).alias(f"__m_{o}") for o in outcomes])
    return panel.crossJoin(F.broadcast(means)).withColumns({o: F.col(o).cast("double") - F.col(f"__m_{o}") for o in outcomes}).drop(*[f"__m_{o}" for o in outcomes])  # one row


def axis_mask(axes: list[str]):
    """Bit j is set where axis j is present; grouping_id sets a bit where a column is aggregated out, the first column highest."""
    k = len(axes)
    gid = F.grouping_id()
    return sum(((1 - gid.bitwiseAND(1 << (k - 1 - j)) / (1 << (k - 1 - j))).cast("int") * (1 << j)) for j in range(k))


def marginals(panel: DataFrame, outcomes: list[str], axes: list[str]) -> DataFrame:
    """mask, row, col, groups, q: groups of each subset T of the axes and N / n_T times the sum of products of its means."""
    cells = centred(panel.select(*axes, *outcomes), outcomes)
    cube = cells.cube(*axes).agg(F.count("*").alias("__n"), axis_mask(axes).alias("mask"), *[F.avg(o).alias(f"__a_{o}") for o in outcomes])
    pairs = [(a, b) for i, a in enumerate(outcomes) for b in outcomes[i:]]
    per = cube.groupBy("mask").agg(F.count("*").alias("groups"), *[F.sum(F.col("__n") * F.col(f"__a_{a}") * F.col(f"__a_{b}")).alias(f"__q{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col(f"__q{i}").alias("q")) for i, (a, b) in enumerate(pairs)])).alias("r")
    return per.select("mask", "groups", rows).select("mask", "r.row", "r.col", "groups", "r.q")


def _pick(ms, mask, row, col):
    """The marginals of one subset and pair."""
    return F.get(F.filter(ms, lambda x: (x["mask"] == mask) & (x["row"] == row) & (x["col"] == col)), F.lit(0))


def strata(panel: DataFrame, outcomes: list[str], axes: list[str]) -> DataFrame:
    """mask, row, col, df, sscp of every stratum.

    The marginals (2^k subsets for each pair of outcomes) travel as one array in one row, so the panel is read once and nothing is joined.
    """
    one = marginals(panel, outcomes, axes).agg(F.collect_list(F.struct("mask", "row", "col", "groups", "q")).alias("ms"))
    sizes = {f"n{j}": _pick("ms", 1 << j, outcomes[0], outcomes[0])["groups"] for j in range(len(axes))}
    rows = one.withColumns(sizes).select("ms", *sizes, F.inline("ms"))
    inside = F.filter("ms", lambda x: (x["mask"].bitwiseAND(F.col("mask")) == x["mask"]) & (x["row"] == F.col("row")) & (x["col"] == F.col("col")))
    sign = lambda x: F.when((F.bit_count("mask") - F.bit_count(x["mask"])) % 2 == 0, 1.0).otherwise(-1.0)
    df = F.lit(1)
    for j in range(len(axes)):
        df = df * F.when(F.col("mask").bitwiseAND(1 << j) != 0, F.col(f"n{j}") - 1).otherwise(1)
    return rows.select("mask", "row", "col", df.cast("long").alias("df"), F.aggregate(inside, F.lit(0.0), lambda a, x: a + sign(x) * x["q"]).alias("sscp"), *sizes)


def moment_components(panel: DataFrame, outcomes: list[str], axes: list[str]) -> DataFrame:
    """mask, source, row, col, component: raw moment estimates of the saturated design; negative ones stay.

    The mean product of stratum S estimates the sum over g containing S of
    (product of the levels outside g) times component g, so
    component S = 1 / prod(levels outside S) * sum over g containing S of (-1)^|g - S| * mean product g.
    The full-cell source is the residual.
    """
    k = len(axes)
    s = strata(panel, outcomes, axes).where("mask <> 0")
    sizes = [f"n{j}" for j in range(k)]
    one = s.agg(F.collect_list(F.struct("mask", "row", "col", (F.col("sscp") / F.col("df")).alias("ms"))).alias("all"), *[F.max(n).alias(n) for n in sizes])
    rows = one.select("all", *sizes, F.inline("all"))
    above = F.filter("all", lambda x: (x["mask"].bitwiseAND(F.col("mask")) == F.col("mask")) & (x["row"] == F.col("row")) & (x["col"] == F.col("col")))
    sign = lambda x: F.when((F.bit_count(x["mask"]) - F.bit_count("mask")) % 2 == 0, 1.0).otherwise(-1.0)
    total = F.aggregate(above, F.lit(0.0), lambda a, x: a + sign(x) * x["ms"])
    outside = F.lit(1.0)
    for j in range(k):
        outside = outside * F.when(F.col("mask").bitwiseAND(1 << j) == 0, F.col(f"n{j}")).otherwise(1)
    label = F.concat_ws(":", *[F.when(F.col("mask").bitwiseAND(1 << j) != 0, F.lit(a)) for j, a in enumerate(axes)])
    source = F.when(F.col("mask") == (1 << k) - 1, F.lit("Residual")).otherwise(label)
    return rows.select("mask", source.alias("source"), "row", "col", (total / outside).alias("component"))


def deviance(strata_table: DataFrame, components: dict[str, float], axes: list[str], reml: bool = True) -> DataFrame:
    """One row: the exact -2 log likelihood of one outcome for given components, from its strata alone."""
    k = len(axes)
    masks = {s: (0 if s == "Residual" else sum(1 << axes.index(a) for a in s.split(":"))) for s in components}
    lam = F.lit(float(components["Residual"]))
    for s, m in masks.items():
        if s == "Residual":
            continue
        outside = F.lit(1.0)
        for j in range(k):
            if not m & (1 << j):
                outside = outside * F.col(f"n{j}")
        lam = lam + F.when(F.col("mask").bitwiseAND(m) == F.col("mask"), outside * float(components[s])).otherwise(0.0)
    n = F.lit(1.0)
    for j in range(k):
        n = n * F.col(f"n{j}")
    rows = strata_table.where("mask <> 0") if reml else strata_table
    quad = F.when(F.col("mask") == 0, 0.0).otherwise(F.col("sscp") / lam)
    body = rows.agg(F.sum(F.col("df") * F.log(lam) + quad).alias("body"), F.max(n).alias("n"))
    head = (F.col("n") - (1 if reml else 0)) * F.log(F.lit(2 * 3.141592653589793)) + (F.log("n") if reml else F.lit(0.0))
    return body.select((head + F.col("body")).alias("deviance"))


def correlations(components: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """source, row, col, correlation; null where a variance is not above the tolerance."""
    diag = components.where("row = col").select("source", F.col("row").alias("v"), F.col("component").alias("var"))
    a, b = diag.select("source", F.col("v").alias("row"), F.col("var").alias("va")), diag.select("source", F.col("v").alias("col"), F.col("var").alias("vb"))
    ok = (F.col("va") > tolerance) & (F.col("vb") > tolerance)
    return components.join(a, ["source", "row"]).join(b, ["source", "col"]).select("source", "row", "col", F.when(ok, F.col("component") / F.sqrt(F.col("va") * F.col("vb"))).alias("correlation"))
