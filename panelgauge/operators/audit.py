"""Panel audit, outcome profiles and preflight checks."""

from __future__ import annotations

from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import Design, SpecError


def null_counts(panel: DataFrame, columns: list[str]) -> DataFrame:
    """One row: nulls (and NaN) of each column, in one pass."""
    kinds = dict(panel.dtypes)
    bad = lambda c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))
    return panel.agg(*[F.coalesce(F.sum(bad(c).cast("long")), F.lit(0)).alias(c) for c in columns])


def reject_nulls(panel: DataFrame, columns: list[str]) -> DataFrame:
    found = null_counts(panel, columns).first().asDict()
    if any(found.values()):
        raise SpecError(f"missing values in {[c for c, n in found.items() if n]}")
    return panel


def level_counts(panel: DataFrame, variables: list[str]) -> DataFrame:
    """variable, levels: distinct levels of each design column."""
    wide = panel.agg(*[F.count_distinct(v).alias(v) for v in variables])
    return wide.unpivot([], variables, "variable", "levels")


def cell_counts(panel: DataFrame, axes: list[str]) -> DataFrame:
    return panel.groupBy(*axes).agg(F.count("*").alias("rows"))


def exact_cell_total(levels: dict[str, int]) -> int:
    return prod(levels.values())


def cell_status(panel: DataFrame, axes: list[str], replicates: int = 1) -> DataFrame:
    """status, cell_count, cell_count_exact: complete, under, over and missing cells. Missing cells are counted, never enumerated."""
    cells = cell_counts(panel, axes)
    hit = lambda c: F.sum(c.cast("long"))
    one = cells.agg(
        F.count("*").alias("cells"), hit(F.col("rows") == replicates).alias("complete"), hit(F.col("rows") < replicates).alias("under_replicated"), hit(F.col("rows") > replicates).alias("over_replicated"),
        *[F.count_distinct(a).alias(f"levels_{j}") for j, a in enumerate(axes)],
    ).first()
    # the product of the levels is exact in Python, whatever its number of digits
    counts = {s: one[s] or 0 for s in ("complete", "under_replicated", "over_replicated")}
    counts["missing"] = exact_cell_total({a: one[f"levels_{j}"] for j, a in enumerate(axes)}) - one["cells"]
    return panel.sparkSession.createDataFrame([(s, float(n), str(n)) for s, n in counts.items()], "status string, cell_count double, cell_count_exact string")


def missing_cells(panel: DataFrame, axes: list[str], max_examples: int = 20) -> DataFrame:
    """The first missing cells by level value.

    The grid is walked axis by axis: of the prefixes found so far (at most
    ``max_examples``) those that lack cells below them are extended by the next axis.
    """
    cells = panel.select(*axes).distinct()
    sizes = cells.agg(*[F.count_distinct(a).alias(f"n{j}") for j, a in enumerate(axes)]).first()
    prefix = None
    for j, a in enumerate(axes):
        below = prod(sizes[f"n{k}"] for k in range(j + 1, len(axes)))
        by, levels = axes[: j + 1], panel.select(a).distinct()
        near = cells if prefix is None else cells.join(F.broadcast(prefix), axes[:j])
        have = near.groupBy(*by).agg(F.count("*").alias("rows_below"))
        grid = levels if prefix is None else levels.crossJoin(F.broadcast(prefix))  # at most max_examples rows
        prefix = grid.join(have, by, "left").where(F.coalesce("rows_below", F.lit(0)) < below).select(*by).orderBy(*by).limit(max_examples)
    return prefix


def replication_issues(panel: DataFrame, axes: list[str], replicates: int = 1, max_examples: int = 20) -> DataFrame:
    """The first observed cells whose row count is not the declared one (a report of bounded length)."""
    return cell_counts(panel, axes).where(F.col("rows") != replicates).orderBy(*axes).limit(max_examples)


def completeness(panel: DataFrame, axes: list[str], replicates: int = 1) -> DataFrame:
    """One row: rows, observed_cells, expected_cells, min_rows, max_rows, balanced."""
    cells = cell_counts(panel, axes)
    expected = reduce(lambda a, b: a * b, [F.count_distinct(a) for a in axes])
    one = cells.agg(F.sum("rows").alias("rows"), F.count("*").alias("observed_cells"), expected.alias("expected_cells"), F.min("rows").alias("min_rows"), F.max("rows").alias("max_rows"))
    ok = (F.col("observed_cells") == F.col("expected_cells")) & (F.col("min_rows") == replicates) & (F.col("max_rows") == replicates)
    return one.withColumn("balanced", ok)


def sources_table(panel: DataFrame, design: Design, outcomes: int = 1) -> DataFrame:
    """source, observed_groups, predictor_dimensions, random_dimension, covariance_parameters."""
    names = list(design.terms)
    wide = panel.agg(*[F.count_distinct(F.struct(*design.terms[t])).alias(t) for t in names])
    long = wide.unpivot([], [F.col(f"`{t}`") for t in names], "source", "observed_groups")
    return long.withColumns({"predictor_dimensions": F.lit(outcomes), "random_dimension": F.col("observed_groups") * outcomes, "covariance_parameters": F.lit(outcomes * (outcomes + 1) // 2)})


def _in_sets(rows: DataFrame, sets: list[tuple[str, ...]], aggregates: list[Column]) -> DataFrame:
    """One pass over rows for several groupings: the aggregates of each group, and ``gid``, the number of its set."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    number = {frozenset(s): k for k, s in enumerate(sets)}
    bits = {}
    for s, k in number.items():  # grouping_id sets the bit of a column that is aggregated out, the first column highest
        bits[sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s)] = k
    at = F.create_map(*[F.lit(x) for kv in bits.items() for x in (int(kv[0]), int(kv[1]))])
    return rows.groupingSets([list(s) for s in sets], *columns).agg(F.grouping_id().cast("int").alias("gid"), *aggregates).withColumn("gid", at[F.col("gid")])


def kernel_gram(panel: DataFrame, design: Design) -> DataFrame:
    """source_a, source_b, gram: inner products of the source kernels, from joint group counts; no row-by-row matrix is formed."""
    names = list(design.terms)
    pairs = [(a, b, tuple(m for m in design.variables if m in design.terms[a] + design.terms[b])) for i, a in enumerate(names) for b in names[i:]]
    sets = list(dict.fromkeys(m for *_, m in pairs))
    cells = panel.groupBy(*design.variables).agg(F.count("*").alias("cell_rows"))
    n = _in_sets(cells, sets, [F.sum("cell_rows").alias("n")])
    grams = n.groupBy("gid").agg(F.sum((F.col("n") * F.col("n")).cast("double")).alias("gram"))
    side = panel.sparkSession.createDataFrame([(a, b, sets.index(m)) for a, b, m in pairs], "source_a string, source_b string, gid int")
    return side.join(F.broadcast(grams), "gid").select("source_a", "source_b", "gram")  # one row for each pair of sources


def kernel_rank(panel: DataFrame, design: Design, tolerance: float = 1e-9) -> tuple[int, int]:
    """Rank of the kernels' Gram matrix and their number: sources can be told apart if both agree."""
    import numpy as np

    names = list(design.terms)
    m = np.zeros((len(names), len(names)))
    for r in kernel_gram(panel, design).collect():  # one row for each pair of sources
        i, j = names.index(r["source_a"]), names.index(r["source_b"])
        m[i, j] = m[j, i] = r["gram"]
    scale = np.sqrt(np.diag(m))
    values = np.linalg.eigvalsh(m / np.outer(scale, scale))
    return int((values > tolerance * max(1.0, values[-1])).sum()), len(names)


def numeric_profile(panel: DataFrame, outcome: str) -> DataFrame:
    o = F.col(outcome)
    return panel.agg(F.count(o).alias("n"), F.count_distinct(o).alias("n_distinct"), F.min(o).alias("min"), F.max(o).alias("max"), F.avg(o).alias("mean"), F.stddev_samp(o).alias("sd"))


def category_profile(panel: DataFrame, outcome: str, levels: list) -> DataFrame:
    """Counts and shares of every declared level, also those that don't occur."""
    names = panel.sparkSession.createDataFrame([(x,) for x in levels], f"category {dict(panel.dtypes)[outcome]}")
    n = panel.groupBy(F.col(outcome).alias("category")).agg(F.count("*").alias("n"))
    total = panel.agg(F.count(outcome).alias("total"))
    return names.join(n, "category", "left").crossJoin(F.broadcast(total)).select("category", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("proportion"))  # total: one row


def category_coverage(panel: DataFrame, outcome: str, variables: list[list[str]]) -> DataFrame:
    """variable, category, groups_with_category, groups, coverage. A nested facet is grouped with its ancestors. One pass for all variables."""
    sets = [tuple(v) for v in variables]
    columns = list(dict.fromkeys(c for s in sets for c in s))
    seen = panel.groupBy(*columns, F.col(outcome).alias("category")).agg(F.lit(1).alias("one"))
    g = _in_sets(seen, sets, [F.collect_set("category").alias("categories")])  # a group's set holds distinct categories
    names = F.array(*[F.lit(":".join(s)) for s in sets])
    total = g.groupBy("gid").agg(F.count("*").alias("groups"))
    per = g.select("gid", F.explode("categories").alias("category")).groupBy("gid", "category").agg(F.count("*").alias("groups_with_category"))
    both = per.join(F.broadcast(total), "gid")  # one row for each variable
    return both.select(names[F.col("gid")].alias("variable"), "category", "groups_with_category", "groups", (F.col("groups_with_category") / F.col("groups")).alias("coverage"))


def no_variation_groups(panel: DataFrame, outcome: str, variables: list[list[str]]) -> DataFrame:
    """variable, groups, no_variation, single_row. One pass for all variables; groups are compared by their least and greatest value."""
    sets = [tuple(v) for v in variables]
    g = _in_sets(panel, sets, [F.count("*").alias("n"), F.min(outcome).alias("lo"), F.max(outcome).alias("hi")])
    same = F.coalesce(F.col("lo") == F.col("hi"), F.lit(True))
    names = F.array(*[F.lit(":".join(s)) for s in sets])
    return g.groupBy("gid").agg(F.count("*").alias("groups"), F.sum(same.cast("long")).alias("no_variation"), F.sum((F.col("n") == 1).cast("long")).alias("single_row")).select(names[F.col("gid")].alias("variable"), "groups", "no_variation", "single_row")


def preflight_gaussian(panel: DataFrame, design: Design, outcomes: list[str], max_axes: int = 12) -> DataFrame:
    """check, passed: whether the exact balanced engine can fit; one aggregate over the cells."""
    axes = list(design.variables)
    cells = panel.groupBy(*axes).agg(F.count("*").alias("rows"))
    expected = reduce(lambda a, b: a * b, [F.count_distinct(a) for a in axes])
    groups = [F.count_distinct(F.struct(*m)) >= 2 for m in design.terms.values()]
    one = cells.agg(
        (F.min("rows") == design.replicates).alias("lo"),
        (F.max("rows") == design.replicates).alias("hi"),
        (F.count("*") == expected).alias("complete"),
        (F.max("rows") == 1).alias("one"),
        reduce(lambda a, b: a & b, groups).alias("groups"),
    )
    spread = panel.agg(*[(F.count_distinct(o) > 1).alias(f"v{i}") for i, o in enumerate(outcomes)])
    checks: list[tuple[str, Column]] = [
        ("declared_replication", F.col("lo") & F.col("hi")),
        ("repeated_source_groups", F.col("groups")),
        ("complete_coded_panel", F.col("complete")),
        ("one_row_per_cell", F.col("one")),
        ("factorial_strata_limit", F.lit(len(axes) <= max_axes)),
        ("outcome_variation", reduce(lambda a, b: a & b, [F.col(f"v{i}") for i in range(len(outcomes))])),
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), c.alias("passed")) for n, c in checks])).alias("r")
    return one.crossJoin(F.broadcast(spread)).select(rows).select("r.check", "r.passed")  # one row each


def data_identity(panel: DataFrame, columns: list[str]) -> DataFrame:
    """An order-independent digest: row digests are counted per value and combined by commutative sums."""
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    half = lambda k: F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")
    sums = panel.agg(F.count("*").alias("n"), *[F.sum(half(k)).alias(f"s{k}") for k in range(8)])
    return sums.select(F.sha2(F.concat_ws(":", "n", *[f"s{k}" for k in range(8)]), 256).alias("identity"))
