"""Preflight: named checks of a panel against an engine, before anything is fitted.

All data-sized facts come from a few aggregates (cells, groups of each source,
labels); what is collected is one row for each of them. A check's ``passed`` is
null where an earlier one leaves it open. ``fitting_feasible`` is the AND of all.
"""

from __future__ import annotations

from functools import reduce
from math import prod

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import CALL, Control, Design, Family, SpecError
from . import audit
from .laplace import blocks_of, covariance_bases

Check = tuple[str, bool | None, str]


def _facts(panel: DataFrame, design: Design) -> dict:
    """One row over the cells: rows, cells, least and most rows of a cell, levels of each axis, groups of each source and their most rows."""
    axes = list(design.variables)
    cells = audit.cell_counts(panel, axes)
    one = cells.agg(
        F.sum("rows").alias("rows"), F.count("*").alias("cells"), F.min("rows").alias("lo"), F.max("rows").alias("hi"),
        *[F.count_distinct(a).alias(f"level_{j}") for j, a in enumerate(axes)],
        *[F.count_distinct(F.struct(*m)).alias(f"group_{j}") for j, m in enumerate(design.terms.values())],
    ).first()
    out = {k: one[k] or 0 for k in ("rows", "cells", "lo", "hi")}
    out["levels"] = {a: one[f"level_{j}"] for j, a in enumerate(axes)}
    out["groups"] = {s: one[f"group_{j}"] for j, s in enumerate(design.terms)}
    out["expected"] = prod(out["levels"].values())
    return out


def _common(facts: dict, design: Design, family: str) -> list[Check]:
    replicated = facts["lo"] == facts["hi"] == design.replicates
    out: list[Check] = [("declared_replication", replicated, f"{facts['lo']} to {facts['hi']} rows a cell, {design.replicates} declared")]
    try:
        design.resolve(family, {facts["lo"], facts["hi"]} if facts["cells"] else None)
        out.append(("family_design_resolution", True, ""))
    except SpecError as e:
        out.append(("family_design_resolution", False, str(e)))
    few = [s for s, n in facts["groups"].items() if n < 2]
    out.append(("repeated_source_groups", not few, ", ".join(few)))
    if design.batch is not None:
        out.append(("call_source_name", CALL not in design.terms and CALL not in design.variables, ""))
    return out


def gaussian_checks(panel: DataFrame, design: Design, outcomes: list[str], control: Control = Control()) -> list[Check]:
    """The exact engine: a complete coded panel with one row per cell, and at most max_axes axes."""
    facts = _facts(panel, design)
    axes = len(design.variables) + (1 if design.batch is not None else 0)
    varies = panel.agg(*[(F.count_distinct(o) > 1).alias(f"v{i}") for i, o in enumerate(outcomes)]).first()
    need = 8 * 2**axes * (len(outcomes) * (len(outcomes) + 1) // 2 + 4)
    return [
        *_common(facts, design, "gaussian"),
        ("complete_coded_panel", facts["cells"] == facts["expected"], f"{facts['cells']} of {facts['expected']} cells"),
        ("one_row_per_cell", facts["hi"] <= 1, f"at most {facts['hi']} rows a cell"),
        ("factorial_strata_limit", axes <= control.max_axes, f"{axes} of {control.max_axes} axes"),
        ("preparation_resource_limit", need <= control.max_bytes, f"{need} bytes of strata"),
        ("outcome_variation", all(bool(x) for x in varies), ", ".join(o for o, x in zip(outcomes, varies, strict=True) if not x)),
        ("second_engine_single_outcome", len(outcomes) == 1, "the observed-row engine, a second evaluation of the likelihood, takes one outcome"),
    ]


def observed_checks(panel: DataFrame, design: Design, control: Control = Control()) -> list[Check]:
    """The observed-row engine: bounded rows, no batch, and source kernels that can be told apart from each other and the residual."""
    facts = _facts(panel, design)
    out = [*_common(facts, design, "gaussian"), ("one_row_per_cell", facts["hi"] <= 1, ""), ("observed_row_limit", facts["rows"] <= control.max_rows_observed, f"{facts['rows']} of {control.max_rows_observed} rows"), ("observed_row_no_batches", design.batch is None, "")]
    out.append(("observed_covariance_identification", *_kernels_apart(panel, design.resolve("gaussian"), facts["rows"])))
    return out


def _kernels_apart(panel: DataFrame, design: Design, rows: int) -> tuple[bool, str]:
    """Whether the source kernels and the identity are independent: their Gram matrix, from joint group counts, has full rank."""
    names = list(design.terms)
    m = np.zeros((len(names) + 1,) * 2)
    for r in audit.kernel_gram(panel, design).collect():  # one row for each pair of sources
        i, j = names.index(r["source_a"]), names.index(r["source_b"])
        m[i, j] = m[j, i] = r["gram"]
    m[-1, :] = m[:, -1] = rows
    scale = np.sqrt(np.diag(m))
    rank = int((np.linalg.eigvalsh(m / np.outer(scale, scale)) > 1e-9).sum()) if (scale > 0).all() else 0
    return rank == len(m), f"rank {rank} of {len(m)} kernels"


def discrete_checks(panel: DataFrame, design: Design, outcomes: list[str], families: list[Family], control: Control = Control(), covariance: dict[str, str] | None = None) -> list[Check]:
    """The Laplace engine: covered categories, repeated observations, limits of rows, effects, parameters and memory, covariance and kernels."""
    facts = _facts(panel, design)
    out: list[Check] = []
    levels: list[tuple] = []
    for o, f in zip(outcomes, families, strict=True):
        seen = {r[0] for r in panel.groupBy(o).count().select(o).limit(1001).collect()}
        declared = f.levels or tuple(sorted(seen, key=str))
        levels.append(tuple(declared))
        lost, odd = set(declared) - seen, seen - set(declared)
        out.append(("outcome_category_coverage", not lost and not odd, f"{o}: " + "; ".join([*(["absent: " + ", ".join(sorted(map(str, lost)))] if lost else []), *(["undeclared: " + ", ".join(sorted(map(str, odd)))] if odd else [])])))
    out += _common(facts, design, families[0].family)
    full = ":".join(design.variables)
    terms = {s: m for s, m in design.terms.items() if s != full or design.replicates > 1}
    groups = {s: facts["groups"][s] for s in terms}
    thin = [s for s, n in groups.items() if n >= facts["rows"]]
    out.append(("repeated_observations_within_source", not thin, ", ".join(thin)))
    distinct = panel.groupBy(*design.variables, *outcomes).count().count()
    out.append(("observation_limit", distinct <= control.max_rows_discrete, f"{distinct} of {control.max_rows_discrete} distinct rows"))
    blocks = blocks_of({o: (f, lv) for o, f, lv in zip(outcomes, families, levels, strict=True)})
    d = blocks[-1].first + blocks[-1].dims
    total = sum(groups.values()) * d
    rest = total - max(groups.values(), default=0) * d
    out.append(("random_dimension_limit", total <= control.max_random_dim and rest <= control.max_dense_dim, f"{total} random effects, {rest} beside the largest source"))
    kinds = {s: (covariance or {}).get(s, "diagonal" if d == 1 else "unstructured") for s in groups}
    try:
        if set(covariance or {}) - set(groups):
            raise SpecError("covariance names no source")
        n = sum(b.parameters for b in blocks) + sum(len(covariance_bases(k, blocks)) for k in kinds.values())
        specified = (True, ", ".join(f"{s}: {k}" for s, k in kinds.items()))
    except SpecError as e:
        n, specified = 0, (False, str(e))
    out.append(("parameter_limit", n <= control.max_parameters, f"{n} of {control.max_parameters} parameters"))
    need = 8 * (3 * rest * rest + 3 * rest * (total - rest))
    out.append(("sparse_memory_limit", need <= control.max_bytes, f"{need} of {control.max_bytes} bytes with the largest source eliminated"))
    out.append(("dense_memory_limit", 8 * total * total <= control.max_bytes, f"{8 * total * total} bytes as one dense matrix; the engine does not form it"))
    slopes = 8 * facts["rows"] * d * d * (len(groups) + 2)
    out.append(("analytic_gradient_caps", slopes <= control.max_bytes, f"{slopes} bytes of row blocks"))
    open_ = all(p for name, p, _ in out if name != "dense_memory_limit")
    out.append(("covariance_specification", specified[0] if open_ else None, specified[1] if open_ else "earlier checks failed"))
    out.append(("boundary_escape_coordinates", specified[0] if open_ else None, "factors are free of sign, a zero factor is left along itself"))
    out.append(("analytic_gradient_coordinates", specified[0] if open_ else None, "every covariance choice is linear in its factor"))
    rank, m = audit.kernel_rank(panel, Design(design.object, design.facets, terms, design.replicates))
    out.append(("source_kernel_independence", rank == m, f"rank {rank} of {m} kernels"))
    separate = facts["hi"] > 1 or _kernels_apart(panel, Design(design.object, design.facets, terms, design.replicates), facts["rows"])[0]
    out.append(("source_residual_separation", separate, ""))
    return out


def feasible(checks: list[Check]) -> bool:
    """The AND of all checks that bind the engine."""
    return all(passed for name, passed, _ in checks if name not in ("dense_memory_limit", "second_engine_single_outcome"))


def supported_scale(checks: list[Check], design: Design, family: str) -> str:
    """observed (Gaussian), latent (discrete), or none where the panel is unbalanced or a category is absent, or the call is modelled."""
    bad = {name for name, passed, _ in checks if not passed}
    if design.batch is not None or bad & {"complete_coded_panel", "outcome_category_coverage", "declared_replication"}:
        return "none"
    return "observed" if family == "gaussian" else "latent"


def as_table(spark: SparkSession, checks: list[Check]) -> DataFrame:
    return spark.createDataFrame(checks, "check string, passed boolean, detail string")


def call_groups_of(panel: DataFrame, layout: DataFrame, design: Design) -> DataFrame:
    """The panel with ``call``: one number-free key (batch and all facets) for each shared request."""
    return panel.join(layout.withColumnRenamed("item", design.object), design.object).withColumn("call", F.struct("batch", *design.facets))


def reasons(checks: list[Check]) -> str:
    return "; ".join(f"{n}: {d}" if d else n for n, p, d in checks if not p)


def require(checks: list[Check]) -> None:
    """Stop with the failed checks' names."""
    if not feasible(checks):
        raise SpecError(f"the panel can't be fitted: {reasons(checks)}")


def largest_sources(table: DataFrame, n: int = 10) -> DataFrame:
    """The sources with most observed groups, for a plot."""
    return table.orderBy(F.desc("observed_groups"), "source").limit(n)


def source_pairs(panel: DataFrame, design: Design) -> DataFrame:
    """source_a, source_b, pairs: distinct pairs of groups that occur together, the nonzero blocks of a penalised Hessian."""
    names = list(design.terms)
    sets = {(a, b): tuple(m for m in design.variables if m in design.terms[a] + design.terms[b]) for i, a in enumerate(names) for b in names[i:]}
    keys = list(dict.fromkeys(sets.values()))
    one = panel.agg(*[F.count_distinct(F.struct(*k)).alias(f"k{j}") for j, k in enumerate(keys)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("source_a"), F.lit(b).alias("source_b"), F.col(f"k{keys.index(k)}").alias("pairs")) for (a, b), k in sets.items()]))
    return one.select(rows.alias("r")).select("r.*")


def total_effects(table: DataFrame) -> int:
    return reduce(lambda a, b: a + b, [r["random_dimension"] for r in table.select("random_dimension").collect()], 0)  # one row per source
