"""Shared-call batches: inferred and recorded layouts, audit, and batch-aware reliability targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import CALL, RESIDUAL, Design
from .ranking import ordered_place


def inferred(panel: DataFrame, object: str, order: str, size: int) -> DataFrame:
    """item, batch, position from the rank of each item's order value; ranks come slice by slice, never from one window over all items."""
    items = panel.groupBy(F.col(object).alias("item")).agg(F.min(order).alias("lo"))
    rank = F.col("place") - 1
    return ordered_place(items, "lo", "item").select("item", (F.floor(rank / size) + 1).cast("long").alias("batch"), (rank % size + 1).cast("long").alias("position"))


def inferred_problems(panel: DataFrame, object: str, order: str) -> DataFrame:
    """varying_items, tied_items: why an inferred layout is refused."""
    items = panel.groupBy(object).agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    ties = items.groupBy("lo").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("tied_items"))
    return items.agg(F.sum((F.col("lo") != F.col("hi")).cast("long")).alias("varying_items")).crossJoin(F.broadcast(ties))  # one row


def recorded(panel: DataFrame, object: str, call: str, order: str) -> DataFrame:
    """Rows with their position within the recorded call."""
    return panel.withColumn("position", F.row_number().over(Window.partitionBy(call).orderBy(order, object)))


def call_groups(panel: DataFrame, object: str, call: str, facets: list[str]) -> DataFrame:
    """call, rows, items, conditions, composition (sorted items) of each call."""
    return panel.groupBy(call).agg(F.count("*").alias("rows"), F.count_distinct(object).alias("items"), F.count_distinct(F.struct(*facets)).alias("conditions"), F.concat_ws(",", F.array_sort(F.collect_set(F.col(object)).cast("array<string>"))).alias("composition"))


def recorded_audit(panel: DataFrame, object: str, call: str, facets: list[str], order: str, size: int) -> DataFrame:
    """One row: calls, batches, spanning, repeated, oversized, tied calls, largest call, fixed composition."""
    groups = panel.groupBy(call).agg(
        F.count("*").alias("rows"), F.count_distinct(object).alias("items"), F.count_distinct(F.struct(*facets)).alias("conditions"), F.count_distinct(order).alias("orders"),
        F.sha2(F.to_json(F.array_sort(F.collect_set(object))), 256).alias("members"), F.min(F.struct(*facets)).alias("condition"),
    )  # a call holds at most a request's items; from here on its members are one digest
    seen = groups.groupBy("condition", "members").agg(F.lit(1).alias("one"))
    fixed = seen.agg((F.count("*") == F.count_distinct("condition") * F.count_distinct("members")).alias("fixed_composition"))
    flag = lambda c: F.sum(c.cast("long"))
    one = groups.agg(F.count("*").alias("calls"), F.count_distinct("members").alias("batches"), flag(F.col("conditions") > 1).alias("spanning"), flag(F.col("rows") > F.col("items")).alias("repeated"), flag(F.col("rows") > size).alias("oversized"), flag(F.col("orders") < F.col("rows")).alias("tied"), F.max("rows").alias("largest"))
    return one.crossJoin(F.broadcast(fixed))  # one row each


def stored_order_audit(panel: DataFrame, object: str, facets: list[str], order: str, size: int) -> DataFrame:
    """One row: conditions, blocks of ``size`` rows in the stored order of each condition, blocks whose items run on by one, and blocks that hold the same items in every condition.

    ``order`` is the explicit column that stands for the stored order; a condition's rows are ranked in slices.
    """
    from .ranking import grouped_rank

    placed = grouped_rank(panel.select(object, *facets, F.col(order).cast("double").alias("__order")), facets, "__order")
    blocks = placed.withColumn("block", F.floor((F.col("rank") - 1) / size).cast("long"))
    per = blocks.groupBy(*facets, "block").agg(F.count("*").alias("n"), F.sha2(F.to_json(F.array_sort(F.collect_set(object))), 256).alias("members"), (F.count_distinct(object) == F.count("*")).alias("distinct"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))  # a block holds ``size`` rows
    seen = per.groupBy("block").agg(F.count("*").alias("conditions"), F.count_distinct("members").alias("layouts"), F.min(F.col("n") == size).alias("full"), F.min("distinct").alias("distinct"))
    conditions = panel.select(*facets).distinct().agg(F.count("*").alias("all_conditions"))
    one = seen.agg(F.count("*").alias("blocks"), F.sum(F.col("full").cast("long")).alias("full_blocks"), F.sum((F.col("layouts") == 1).cast("long")).alias("same_items"), F.sum((~F.col("distinct")).cast("long")).alias("repeated_items"))
    return one.crossJoin(F.broadcast(conditions)).select(F.col("all_conditions").alias("conditions"), "blocks", "full_blocks", "same_items", "repeated_items")  # one row each


def eligibility(layout: DataFrame, panel: DataFrame, axes: list[str], size: int) -> DataFrame:
    """modelled and reason: whether equal fixed batches can enter the balanced likelihood."""
    cells = panel.groupBy(*axes).agg(F.count("*").alias("n"))
    complete = cells.agg((F.count("*") == reduce(lambda a, b: a * b, [F.count_distinct(a) for a in axes])).alias("complete"), (F.max("n") == 1).alias("single"))
    sizes = layout.groupBy("batch").agg(F.count("*").alias("n")).agg(F.count("*").alias("batches"), ((F.min("n") == size) & (F.max("n") == size)).alias("equal"))
    reason = F.when(~(F.col("complete") & F.col("single")), "fixed call effects need a complete panel with one row per cell").when(~F.col("equal"), "not every batch holds the declared items").when(F.col("batches") < 2, "there are fewer than two batches")
    return complete.crossJoin(F.broadcast(sizes)).select(reason.isNull().alias("modelled"), reason.alias("reason"), "batches")  # one row each


def kernels(design: Design, counts: dict[str, int]) -> list[tuple[str, str, float, str]]:
    """(source, kernel, divisor, role) of every source, with Call and Residual."""
    whole = float(reduce(lambda a, b: a * b, counts.values(), 1))
    out = [(CALL, "same_batch", whole, "error"), (RESIDUAL, "same_item", whole, "error")]
    for s, members in design.terms.items():
        inside = [m for m in members if m != design.object]
        out.append((s, "same_item" if design.object in members else "all_items", float(reduce(lambda a, b: a * b, [counts[m] for m in inside], 1)), "universe" if s == design.object else "error"))
    return out


def contractions(targets: DataFrame, layout: DataFrame) -> DataFrame:
    """target, target_kind, kernel, contraction: sum w^2, (sum w)^2 and the sum over batches of squared sums, by two group-bys."""
    w = targets.join(layout, "item").groupBy("target", "target_kind", "batch").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q"))
    t = w.groupBy("target", "target_kind").agg(F.sum("q").alias("same_item"), (F.sum("s") * F.sum("s")).alias("all_items"), F.sum(F.col("s") * F.col("s")).alias("same_batch"))
    return t.unpivot(["target", "target_kind"], ["same_item", "all_items", "same_batch"], "kernel", "contraction")


def batch_contributions(contracted: DataFrame, sources: DataFrame, components: DataFrame) -> DataFrame:
    """One row per target, outcome and source: kernel, contraction, divisor, variance."""
    v = components.where("row = col").select("source", F.col("row").alias("outcome"), F.greatest(F.lit(0.0), F.col("component")).alias("v"))
    small = sources.join(v, "source")
    return contracted.join(F.broadcast(small), "kernel").withColumn("variance", F.col("contraction") / F.col("divisor") * F.col("v"))  # sources x outcomes x allocations, bounded by the declaration


def batch_summary(contributions: DataFrame) -> DataFrame:
    """universe_variance, error_variance, error_sd and the coefficient of each target."""
    keys = [c for c in ("design_id", "target", "target_kind", "outcome") if c in contributions.columns]
    part = lambda role: F.sum(F.when(F.col("role") == role, F.col("variance")).otherwise(0.0))
    s = contributions.groupBy(*keys).agg(part("universe").alias("universe_variance"), part("error").alias("error_variance"))
    u, e = F.col("universe_variance"), F.col("error_variance")
    name = F.when(F.col("target_kind") == "absolute_item", "Phi").when(F.col("target_kind") == "contrast", "contrast_reliability").otherwise("aggregate_dependability")
    return s.withColumns({"error_sd": F.sqrt(e), "coefficient": F.when(u + e > 0, u / (u + e)), "coefficient_name": name})
