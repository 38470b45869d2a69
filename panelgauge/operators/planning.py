"""Costed plans over allocation grids: feasibility, screening, minimum cost, Pareto set, ranks, baseline differences."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import SpecError
from .ranking import bounded


def check_currency(currency: str, cost_date: str) -> None:
    if not re.fullmatch(r"[A-Z]{3}", currency or ""):
        raise SpecError("currency must be a three-letter code")
    try:
        if date.fromisoformat(cost_date).isoformat() != cost_date:
            raise ValueError
    except (TypeError, ValueError):
        raise SpecError("cost_date must be a date YYYY-MM-DD") from None


def add_costs(results: DataFrame, costs: Callable[[DataFrame], dict[str, Column]] | dict[str, Column], currency: str, cost_date: str, resources: dict[str, Column] | None = None) -> DataFrame:
    """cost_component_*, resource_* and total_cost; the caller's costs are column expressions and stay in the plan."""
    check_currency(currency, cost_date)
    parts = costs(results) if callable(costs) else costs
    out = results.withColumns({f"cost_component_{n}": c.cast("double") for n, c in parts.items()} | {f"resource_{n}": c for n, c in (resources or {}).items()})
    total = reduce(lambda a, b: a + b, [F.col(f"cost_component_{n}") for n in parts])
    return out.withColumns({"total_cost": total, "currency": F.lit(currency), "cost_date": F.lit(cost_date)})


def constraints(results: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """feasible: false if any is false, null if any is unknown, else true; constraint_reason names both kinds."""
    if not checks:
        return results.withColumns({"feasible": F.lit(True), "constraint_reason": F.lit(None).cast("string")})
    feasible = reduce(lambda a, b: a & b, checks.values())
    listed = lambda head, pick: F.when(reduce(lambda a, b: a | b, [pick(c) for c in checks.values()]), F.concat(F.lit(head), F.concat_ws(", ", *[F.when(pick(c), F.lit(n)) for n, c in checks.items()])))
    reason = F.concat_ws("; ", listed("Failed: ", lambda c: F.coalesce(~c, F.lit(False))), listed("Unknown: ", lambda c: c.isNull()))
    return results.withColumns({"feasible": feasible, "constraint_reason": F.when(reason != "", reason)})


def screen(results: DataFrame, target: float, value: Column) -> DataFrame:
    """screening_value, meets_target, eligible, minimum_cost, cost_rank."""
    every = Window.partitionBy(F.lit(1))  # a grid: bounded() stops at more rows
    out = results.withColumns({"screening_value": value, "target": F.lit(target)}).withColumn("meets_target", F.col("screening_value") >= F.col("target")).withColumn("eligible", F.col("feasible") & F.col("meets_target"))
    least = bounded(F.min(F.when(F.col("eligible"), F.col("total_cost"))).over(every))
    rank = F.rank().over(Window.partitionBy(F.coalesce(F.col("feasible"), F.lit(False))).orderBy("total_cost"))
    return out.withColumns({"minimum_cost": F.when(F.col("eligible").isNotNull(), F.col("eligible") & (F.col("total_cost") == least)), "cost_rank": F.when(F.col("feasible"), rank)})


def pareto(results: DataFrame, cost: str = "total_cost", value: str = "screening_value") -> DataFrame:
    """pareto: among feasible rows with a cost and a value, best at its cost and better than every cheaper one; ties stay; infeasible false, unknown null.

    Windows over one evaluation of ``results``: sums of doubles that are evaluated twice may differ in the last place.
    """
    usable = F.col("feasible") & F.col(value).isNotNull() & F.col(cost).isNotNull()
    before = F.max("__value").over(Window.partitionBy(F.lit(1)).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))  # a grid: bounded() stops at more rows
    same = Window.partitionBy(cost)
    marked = results.withColumn("__value", F.when(usable, F.col(value))).withColumn("__before", bounded(before))
    # the first row of a cost has only cheaper ones before it; null, if there is none, is the least
    found = marked.withColumns({"__here": F.max("__value").over(same), "__cheaper": F.min(F.struct("__before")).over(same)["__before"]})
    front = (F.col("__value") == F.col("__here")) & (F.col("__cheaper").isNull() | (F.col("__value") > F.col("__cheaper")))
    flag = F.when(~F.col("feasible"), F.lit(False)).when(usable, front)
    return found.withColumn("pareto", flag).drop("__value", "__before", "__here", "__cheaper")


def against_baseline(results: DataFrame, baseline: int) -> DataFrame:
    """Differences to one candidate row."""
    names = ["total_cost", "relative_error", "absolute_error", "Erho2", "Phi"]
    base = results.where(F.col("design_id") == baseline).select(*[F.col(n).alias(f"__{n}") for n in names])
    j = results.crossJoin(F.broadcast(base))  # one row
    return j.withColumns({
        "baseline_id": F.lit(baseline),
        "extra_cost": F.col("total_cost") - F.col("__total_cost"),
        "relative_error_reduction": F.col("__relative_error") - F.col("relative_error"),
        "absolute_error_reduction": F.col("__absolute_error") - F.col("absolute_error"),
        "Erho2_gain": F.col("Erho2") - F.col("__Erho2"),
        "Phi_gain": F.col("Phi") - F.col("__Phi"),
    }).drop(*[f"__{n}" for n in names])


def source_contributions(weights: DataFrame, components: DataFrame, baseline: int, outcome: str) -> DataFrame:
    """design_id, source, role and each source's share of universe and error variance, with reductions against the baseline."""
    v = components.where((F.col("row") == outcome) & (F.col("col") == outcome)).select("source", F.col("component").alias("v"))
    w = weights.join(v, "source").select("design_id", "source", "role", *[(F.col(c) * F.col("v")).alias(n) for c, n in (("universe", "universe"), ("relative", "relative_error"), ("absolute", "absolute_error"))])
    base = w.where(F.col("design_id") == baseline).select("source", F.col("relative_error").alias("__r"), F.col("absolute_error").alias("__a"))
    return w.join(F.broadcast(base), "source").select("design_id", "source", "role", "universe", "relative_error", "absolute_error", (F.col("__r") - F.col("relative_error")).alias("relative_error_reduction"), (F.col("__a") - F.col("absolute_error")).alias("absolute_error_reduction"))  # one row per source
