"""Weights, coefficients, decision studies and target screens as one plan over an allocation grid."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..spec import CALL, Design, SpecError
from .ranking import bounded

EXACT = float(2**53)


def allocation_grid(spark: SparkSession, candidates: dict[str, list[int]], max_candidates: int = 10_000) -> DataFrame:
    """design_id and one count per facet; the first facet varies fastest."""
    size = 1
    for f, v in candidates.items():
        if not v or any(not isinstance(x, int) or x < 1 for x in v) or len(set(v)) != len(v):
            raise SpecError(f"counts of {f} must be distinct positive integers")
        size *= len(v)
    if size > max_candidates:
        raise SpecError("too many candidate allocations")
    rows, repeat = spark.range(size).withColumn("design_id", (F.col("id") + 1).cast("long")), 1
    for f, v in candidates.items():
        at = (F.floor(F.col("id") / repeat) % len(v)).cast("int")
        rows = rows.withColumn(f, F.get(F.array(*map(F.lit, v)), at))
        repeat *= len(v)
    return rows.drop("id")


def check_fixed(grid: DataFrame, design: Design, fixed: tuple[str, ...], observed: dict[str, int] | None) -> None:
    """A fixed facet is a facet, another one stays random, and every allocation has it at its observed count."""
    if set(fixed) - set(design.facets) or len(set(fixed)) != len(fixed) or set(design.facets) <= set(fixed):
        raise SpecError("fixed must name facets and leave at least one random")
    if fixed:
        if observed is None or set(fixed) - set(observed):
            raise SpecError("a fixed facet needs its observed count")
        changed = grid.where(reduce(lambda a, b: a | b, [F.col(f) != observed[f] for f in fixed])).limit(1).collect()
        if changed:
            raise SpecError(f"a fixed facet keeps its observed count: {[f for f in fixed if changed[0][f] != observed[f]]}")


def source_weights(grid: DataFrame, design: Design, fixed: tuple[str, ...] = (), observed: dict[str, int] | None = None) -> DataFrame:
    """design_id, source, universe, relative, absolute, role: one row for each allocation and source."""
    if design.batch is not None and CALL in design.terms:
        raise SpecError("ordinary coefficients are not defined when the call is a source; use the batch operators")
    check_fixed(grid, design, fixed, observed)
    product = lambda names: reduce(lambda a, b: a * b, [F.col(n).cast("double") for n in names], F.lit(1.0))
    rows: list[Column] = []

    def row(source, universe, relative, absolute, role):
        rows.append(F.struct(F.lit(source).alias("source"), universe.alias("universe"), relative.alias("relative"), absolute.alias("absolute"), F.lit(role).alias("role")))

    zero = F.lit(0.0)
    for term, members in design.terms.items():
        inside = [m for m in members if m != design.object]
        w = 1.0 / product(inside)
        loose = set(inside) - set(fixed)
        if term == design.object:
            row(term, F.lit(1.0), zero, zero, "universe")
        elif design.object in members:
            row(term, *((zero, w, w, "relative_and_absolute_error") if loose else (w, zero, zero, "universe_after_fixed_facet_averaging")))
        elif loose:
            row(term, zero, zero, w, "absolute_error")
        else:
            row(term, zero, zero, zero, "dropped_fixed_instrumentation_constant")
    w = 1.0 / (product(design.facets) * design.replicates)
    row("Residual", zero, w, w, "relative_and_absolute_error")
    return grid.select("*", F.explode(F.array(*rows)).alias("__w")).select(*grid.columns, "__w.*")


def score_components(components: DataFrame, weights: dict[str, float], name: str = "composite") -> DataFrame:
    """Variance of a weighted composite for each source: off-diagonal entries count twice."""
    at = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    value = F.col("component") * at[F.col("row")] * at[F.col("col")] * F.when(F.col("row") == F.col("col"), 1.0).otherwise(2.0)
    return components.groupBy("source").agg(F.sum(value).alias("component")).select("source", F.lit(name).alias("row"), F.lit(name).alias("col"), "component")


def ratio(u: Column, e: Column) -> Column:
    return F.when(u + e > 0, u / (u + e))


def coefficients(weights: DataFrame, components: DataFrame, kind: str = "outcome") -> DataFrame:
    """design_id, kind, outcome, universe_variance, relative_error, absolute_error, Erho2, Phi. Components are a small table, joined by source.

    A negative (raw moment) component counts as zero, here and in the batch operators.
    """
    diag = components.where("row = col").select("source", F.col("row").alias("outcome"), F.greatest(F.lit(0.0), F.col("component")).alias("v"))
    keep = [c for c in weights.columns if c not in ("source", "universe", "relative", "absolute", "role")]
    part = lambda c: F.sum(F.col(c) * F.col("v"))
    s = weights.join(diag, "source").groupBy(*keep, "outcome").agg(part("universe").alias("universe_variance"), part("relative").alias("relative_error"), part("absolute").alias("absolute_error"))
    u = F.col("universe_variance")
    return s.withColumns({"kind": F.lit(kind), "Erho2": ratio(u, F.col("relative_error")), "Phi": ratio(u, F.col("absolute_error"))})


def logit_interval(value: Column, se: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Wald bounds on the logit scale; null at the boundaries and without a standard error."""
    if not 0 < level < 1:
        raise SpecError("level must lie between 0 and 1")
    z = NormalDist().inv_cdf(1 - (1 - level) / 2)
    ok = (se > 0) & (value > 0) & (value < 1)
    eta, spread = F.log(value / (1 - value)), z * se / (value * (1 - value))
    return F.when(ok, 1 / (1 + F.exp(-(eta - spread)))), F.when(ok, 1 / (1 + F.exp(-(eta + spread))))


def select_results(table: DataFrame, outcome: str | None = None, kind: str | None = None, single: bool = False) -> DataFrame:
    """The rows of one outcome or kind; an empty or (where one outcome is needed) ambiguous choice is refused."""
    out = table
    for column, value in (("outcome", outcome), ("kind", kind)):
        if value is not None:
            out = out.where(F.col(column) == value)
    found = out.select(*[c for c in ("kind", "outcome") if c in out.columns]).distinct().limit(2).collect()
    if not found:
        raise SpecError(f"no result for outcome {outcome!r}, kind {kind!r}")
    if single and len(found) > 1:
        raise SpecError("several results remain: name the outcome and the kind")
    return out


def reporting(table: DataFrame, design: Design, observed: dict[str, int]) -> DataFrame:
    """allocation_*, measurements per object, exactness, extrapolation and batch status."""
    facets = [f for f in design.facets if f in table.columns]
    out = table.withColumn("measurements_per_object", reduce(lambda a, b: a * b, [F.col(f).cast("double") for f in facets], F.lit(float(design.replicates))))
    out = out.withColumns({"measurement_count_exact": F.col("measurements_per_object") < EXACT, "extrapolated": reduce(lambda a, b: a | b, [F.col(f) > observed[f] for f in facets], F.lit(False)), "batch_status": F.lit("declared" if design.batch else "none")})
    return out.withColumnsRenamed({f: f"allocation_{f}" for f in facets})


def dstudy_target(table: DataFrame, target: float, coefficient: str = "Erho2") -> DataFrame:
    """meets_target (three-valued) and fewest_measurements: all ties of the least exact count among those that meet it."""
    if coefficient not in ("Erho2", "Phi") or not 0 < target < 1:
        raise SpecError("coefficient must be Erho2 or Phi, target between 0 and 1")
    every = Window.partitionBy(F.lit(1))  # a grid: bounded() stops at more rows
    out = table.withColumns({"coefficient": F.lit(coefficient), "target": F.lit(target), "estimate": F.col(coefficient)}).withColumn("meets_target", F.col("estimate") >= F.col("target"))
    exact = F.col("meets_target") & F.col("measurement_count_exact")
    least = bounded(F.min(F.when(exact, F.col("measurements_per_object"))).over(every))
    fewest = F.when(F.col("meets_target").isNull(), F.lit(None).cast("boolean")).when(~F.col("meets_target"), F.lit(False)).when(least.isNull(), F.lit(None).cast("boolean")).when(F.col("measurement_count_exact"), F.col("measurements_per_object") == least).otherwise(F.lit(False))
    return out.withColumn("fewest_measurements", fewest)
