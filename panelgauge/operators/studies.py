"""Resampling and simulation studies of fits: object bootstrap with records and intervals, pilot plans and targets, categorical targets and plans.

Every replicate is refitted in a task of its own group by the same REML code as a
whole panel; a replicate depends on seed and number only. What a study keeps is one
record per attempt.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..spec import RESIDUAL, Control, Design, SpecError
from . import resampling, simulate, votes
from .fit import Fit, Prepared, coefficient, fit_prepared, source_masks
from .fit import weights as weights_of
from .reliability import logit_interval

# ------------------------------------------------- refits of complete panels in tasks


def strata_of(y: np.ndarray, axes: list[str], outcomes: list[str]) -> Prepared:
    """Strata of a complete array (one axis for each design column, outcomes last), by Helmert-free projections on each axis."""
    n = y.shape[:-1]
    total = int(np.prod(n))
    z = y - y.reshape(total, -1).mean(0)
    df, sscp = {}, {}
    for mask in range(1 << len(axes)):
        part = z
        for j in range(len(axes)):
            mean = part.mean(j, keepdims=True)
            part = part - mean if mask & (1 << j) else np.broadcast_to(mean, part.shape)
        flat = part.reshape(total, -1)
        sscp[mask] = flat.T @ flat
        df[mask] = float(np.prod([n[j] - 1 if mask & (1 << j) else 1 for j in range(len(axes))]))
    return Prepared(axes, outcomes, list(n), df, sscp)


def complete_array(pdf: pd.DataFrame, axes: list[str], outcomes: list[str]) -> np.ndarray:
    """Cells of a complete panel with one row per cell, as an array."""
    codes = [pd.factorize(pdf[a], sort=True) for a in axes]
    shape = tuple(len(u) for _, u in codes)
    if len(pdf) != int(np.prod(shape)) or pdf.duplicated(axes).any() or min(shape) < 2:
        raise SpecError("the panel is not complete with one row per cell")
    out = np.full((*shape, len(outcomes)), np.nan)
    out[tuple(c for c, _ in codes)] = pdf[outcomes].to_numpy(float)
    if not np.isfinite(out).all():
        raise SpecError("an outcome is missing")
    return out


#: Status of an attempt (fixed values).
ACCEPTED, REFUSED, FIT_ERROR, NO_INTERVAL = "accepted", "numerically_refused", "fit_error", "interval_unavailable"


def refits(panel: DataFrame, keys: list[str], design: Design, outcomes: list[str], counts: dict[str, int], estimator: str = "REML", control: Control = Control(), start: dict[str, np.ndarray] | None = None) -> DataFrame:
    """keys, status, component_<source>_<outcome>, Erho2, Erho2_se, Phi, Phi_se (first outcome) of each group's own fit; nulls where none is accepted."""
    axes = list(design.variables)
    names = [*source_masks(design, axes), RESIDUAL]
    columns = [f"c{k}_{i}" for k in range(len(names)) for i in range(len(outcomes))]
    values = [*columns, "Erho2", "Erho2_se", "Phi", "Phi_se"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {k: [pdf[k].iloc[0]] for k in keys} | {"status": [FIT_ERROR]} | {c: [None] for c in values}
        try:
            p = strata_of(complete_array(pdf, axes, outcomes), axes, outcomes)
            if (np.diag(sum(v for k, v in p.sscp.items() if k)) <= 0).any():
                raise SpecError("an outcome is constant")
            fit = fit_prepared(p, design, estimator, control=control, start=start)
        except (SpecError, np.linalg.LinAlgError):
            return pd.DataFrame(out)
        out["status"] = [ACCEPTED if fit.accepted else REFUSED]
        if fit.accepted:
            for k, s in enumerate(names):
                for i in range(len(outcomes)):
                    out[f"c{k}_{i}"] = [float(fit.components[s][i, i])]
            for kind in ("Erho2", "Phi"):
                v, se = coefficient(fit, counts, outcomes[0], kind=kind)
                out[kind], out[f"{kind}_se"] = [v], [se]
        return pd.DataFrame(out)

    ddl = ", ".join([*[f"{k} long" for k in keys], "status string", *[f"{c} double" for c in values]])
    found = panel.select(*keys, *axes, *outcomes).groupBy(*keys).applyInPandas(one, ddl)  # a group is one simulated or resampled panel
    return found.withColumnsRenamed({f"c{k}_{i}": f"component_{s}_{o}" for k, s in enumerate(names) for i, o in enumerate(outcomes)})


# ------------------------------------------------- bootstrap


def common_layout(panel: DataFrame, design: Design) -> bool:
    """Whether all objects were observed under one set of conditions: their sorted conditions have one digest."""
    each = panel.groupBy(design.object).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*design.facets)))), 256).alias("layout"))  # an object's conditions
    return each.select("layout").distinct().limit(2).count() == 1


def bootstrap(panel: DataFrame, design: Design, outcomes: list[str], counts: dict[str, int], replicates: int = 200, seed: int = 1, max_attempts: int | None = None, control: Control = Control(), start: dict[str, np.ndarray] | None = None) -> DataFrame:
    """One record per attempt: objects are resampled with their whole rows and refitted; ``kept`` marks the first ``replicates`` accepted ones."""
    if replicates < 1 or (max_attempts or replicates) < replicates:
        raise SpecError("max_attempts must be at least the replicates")
    if not common_layout(panel, design):
        raise SpecError("the bootstrap needs one layout that all objects share")
    attempts = max_attempts or replicates
    drawn = resampling.draws(panel.select(*design.variables, *outcomes), design.object, attempts, seed)
    rows = resampling.resample(panel.select(*design.variables, *outcomes), drawn, design.object)
    found = refits(rows, ["attempt"], design, outcomes, counts, control=control, start=start)
    from pyspark.sql import Window

    order = Window.partitionBy(F.lit(1)).orderBy("attempt")  # at most max_attempts rows
    good = F.sum((F.col("status") == ACCEPTED).cast("int")).over(order)
    return found.withColumn("kept", (F.col("status") == ACCEPTED) & (good <= replicates))


def jackknife(panel: DataFrame, design: Design, outcomes: list[str], counts: dict[str, int], max_objects: int = 1000, control: Control = Control()) -> DataFrame:
    """One record per left-out object (``attempt``: its place in the objects' hash order)."""
    from .ranking import hashed_place

    objects = hashed_place(panel.select(design.object).distinct(), [design.object])
    n = objects.count()
    if n > max_objects:
        raise SpecError(f"the jackknife takes at most {max_objects} objects")
    out = panel.sparkSession.range(1, n + 1).withColumnRenamed("id", "attempt")
    rows = panel.select(*design.variables, *outcomes).join(objects, design.object).crossJoin(F.broadcast(out)).where("place <> attempt").drop("place")  # n copies of a panel of n <= max_objects objects
    return refits(rows, ["attempt"], design, outcomes, counts, control=control)


def long_records(records: DataFrame, only_kept: bool = True) -> DataFrame:
    """attempt, component, value of the replicates: components and coefficients."""
    values = [c for c in records.columns if c.startswith("component_") or c in ("Erho2", "Phi")]
    rows = records.where("kept") if only_kept and "kept" in records.columns else records.where(F.col("status") == ACCEPTED)
    return rows.unpivot(["attempt"], [F.col(f"`{c}`") for c in values], "component", "value")


def intervals(records: DataFrame, estimates: dict[str, float], left_out: DataFrame | None = None, level: float = 0.95, minimum: int = resampling.MINIMUM) -> DataFrame:
    """component, estimate, se, lower, upper, finite, method: percentile, or BCa where leave-one-out records are given and the correction is defined."""
    long = long_records(records)
    plain = {r["component"]: r for r in resampling.intervals(long, ["component"], "value", level, minimum).collect()}  # one row for each component
    spark = records.sparkSession
    bca: dict[str, tuple[float, float]] = {}
    if left_out is not None:
        acc = {r["component"]: r["acceleration"] for r in resampling.acceleration(long_records(left_out, False), ["component"], "value").collect()}
        at = F.create_map(*[F.lit(x) for kv in estimates.items() for x in (kv[0], float(kv[1]))])
        below = {r["component"]: r["share"] for r in long.groupBy("component").agg((F.avg((F.col("value") < at[F.col("component")]).cast("double")) + 0.5 * F.avg((F.col("value") == at[F.col("component")]).cast("double"))).alias("share")).collect()}
        for c, share in below.items():
            p = resampling.bca_probabilities(share, acc.get(c, 0.0), level) if share is not None else None
            if p and plain.get(c) and plain[c]["finite"] >= minimum:
                got = long.where(F.col("component") == c).agg(F.array_sort(F.collect_list("value")).alias("v")).select(N.quantile6(F.col("v"), p[0]).alias("lo"), N.quantile6(F.col("v"), p[1]).alias("hi")).first()  # one bootstrap's replicates
                bca[c] = (got["lo"], got["hi"])
    rows = []
    for c, r in sorted(plain.items()):
        lo, hi = bca.get(c, (r["lower"], r["upper"]))
        rows.append((c, estimates.get(c), r["se"], lo, hi, r["finite"], "bca" if c in bca else "percentile"))
    return spark.createDataFrame(rows, "component string, estimate double, se double, lower double, upper double, finite long, method string")


def replicate_coefficients(records: DataFrame, design: Design, grid: list[dict[str, int]], outcome: str) -> DataFrame:
    """attempt, design_id, Erho2, Phi of every kept replicate at every allocation, as column expressions over its components."""
    rows = records.where("kept") if "kept" in records.columns else records.where(F.col("status") == ACCEPTED)
    parts: list[Column] = []
    for n, counts in enumerate(grid, 1):
        w = weights_of(design, counts)
        total = lambda k: reduce(lambda a, b: a + b, [F.col(f"`component_{s}_{outcome}`") * x[k] for s, x in w.items()])  # noqa: B023, E731
        u, e, a = total(0), total(1), total(2)
        parts.append(F.struct(F.lit(n).alias("design_id"), F.when(u + e > 0, u / (u + e)).alias("Erho2"), F.when(u + a > 0, u / (u + a)).alias("Phi")))
    return rows.select("attempt", F.explode(F.array(*parts)).alias("r")).select("attempt", "r.*")


def record_summary(records: DataFrame) -> DataFrame:
    """status, attempts."""
    return records.groupBy("status").agg(F.count("*").alias("attempts"))


# ------------------------------------------------- pilots


def pilot(spark: SparkSession, design: Design, grid: list[dict[str, int]], n_items: int, components: dict[str, float], nsim: int, seed: int = 1, level: float = 0.95, control: Control = Control()) -> DataFrame:
    """design_id, replicate, status, accepted, Erho2, Phi, lower, upper, width of every attempt: simulated, refitted, interval of Erho2."""
    parts = []
    for n, counts in enumerate(grid, 1):
        by = spark.range(1, nsim + 1).select(F.lit(n).cast("long").alias("design_id"), F.col("id").alias("replicate"))
        panel = simulate.gaussian_panel(spark, design, {design.object: n_items} | counts, components, seed=seed, by=by)
        parts.append(refits(panel, ["design_id", "replicate"], design, ["y"], counts, control=control))
    fits = reduce(DataFrame.unionByName, parts)
    lo, hi = logit_interval(F.col("Erho2"), F.col("Erho2_se"), level)
    fits = fits.withColumns({"accepted": F.col("status") == ACCEPTED, "lower": lo, "upper": hi})
    have = F.col("lower").isNotNull() & F.col("upper").isNotNull()
    fits = fits.withColumns({"interval_available": have, "width": F.col("upper") - F.col("lower")})
    return fits.withColumn("status", F.when(F.col("accepted") & ~have, NO_INTERVAL).otherwise(F.col("status")))


def pilot_target_summary(records: DataFrame, reference: DataFrame, value: str = "Erho2") -> DataFrame:
    """design_id, attempted, estimated, reference, mean, bias, rmse, their Monte Carlo errors and the share of intervals that hold the reference."""
    r = records.join(F.broadcast(reference.select("design_id", "reference")), "design_id")  # one row per design
    ok = F.col(value).isNotNull()
    d = F.when(ok, F.col(value) - F.col("reference"))
    covered = F.when(F.col("interval_available"), ((F.col("lower") <= F.col("reference")) & (F.col("reference") <= F.col("upper"))).cast("double"))
    g = r.groupBy("design_id").agg(F.count("*").alias("attempted"), F.sum(ok.cast("long")).alias("estimated"), F.first("reference").alias("reference"), F.avg(F.when(ok, F.col(value))).alias("mean"), F.avg(d).alias("bias"), F.avg(d * d).alias("mse"), F.stddev_samp(d).alias("sd"), F.stddev_samp(d * d).alias("sd2"), F.avg(covered).alias("coverage"))
    n = F.col("estimated")
    return g.select("design_id", "attempted", "estimated", "reference", "mean", "bias", (F.col("sd") / F.sqrt(n)).alias("bias_mcse"), F.sqrt("mse").alias("rmse"), (F.col("sd2") / (2 * F.sqrt("mse") * F.sqrt(n))).alias("rmse_mcse"), "coverage")


def reference_coefficients(spark: SparkSession, design: Design, grid: list[dict[str, int]], components: dict[str, float], kind: str = "Erho2") -> DataFrame:
    """design_id, reference: the coefficient that the simulated components have."""
    rows = []
    for n, counts in enumerate(grid, 1):
        w = weights_of(design, counts)
        u, e = (sum(w[s][k] * v for s, v in components.items()) for k in (0, 1 if kind == "Erho2" else 2))
        rows.append((n, u / (u + e) if u + e > 0 else None))
    return spark.createDataFrame(rows, "design_id long, reference double")


# ------------------------------------------------- categorical targets


def check_scores(scores: dict[str, float] | None, levels: list[str], family: str) -> list[float]:
    """One score for each level; ordinal scores ascend strictly. Without scores an ordinal level's is its place."""
    if scores is None:
        if family != "ordinal":
            raise SpecError("a nominal outcome needs declared scores")
        return [float(i + 1) for i in range(len(levels))]
    if set(scores) != set(levels):
        raise SpecError(f"scores must name the levels {levels}")
    out = [float(scores[x]) for x in levels]
    if not all(np.isfinite(out)) or len(set(out)) == 1 or (family == "ordinal" and any(b <= a for a, b in zip(out, out[1:], strict=False))):
        raise SpecError("scores must be finite and differ; those of an ordinal outcome ascend")
    return out


def target_rows(n_items: int, counts: dict[str, int], replications: int, max_rows: int = 10_000_000) -> int:
    """Simulated rows of a target: two panels per replication. Refused above max_rows."""
    rows = 2 * replications * n_items * int(np.prod(list(counts.values())))
    if rows > max_rows:
        raise SpecError(f"{rows} simulated rows exceed max_rows")
    return rows


def categorical_target(spark: SparkSession, design: Design, counts: dict[str, int], components: dict[str, float], thresholds: list[float], levels: list[str], target: str = "decision_agreement", scores: dict[str, float] | None = None, n_items: int = 200, replications: int = 40, seed: int = 1, max_rows: int = 10_000_000) -> DataFrame:
    """One row: estimate, raw_estimate, mc_se, signal_variance, total_variance, available, reason, decision_diversity of a target from pairs of simulated panels.

    decision_agreement: two panels' pluralities; observed_score: the ratio of the
    panels' mean scores; category_vector: the same of the vector of category shares.
    """
    if target not in ("decision_agreement", "observed_score", "category_vector"):
        raise SpecError("target is decision_agreement, observed_score or category_vector")
    target_rows(n_items, counts, replications, max_rows)
    numbers = check_scores(scores, levels, "ordinal") if target == "observed_score" else None
    sizes = {design.object: n_items} | counts
    if target == "decision_agreement":
        got = simulate.decision_target(spark, design, sizes, components, thresholds, levels, replications, seed)
        zero = F.lit(None).cast("double")
        return got.select(F.lit(target).alias("target"), F.col("agreement").alias("estimate"), F.col("agreement").alias("raw_estimate"), zero.alias("mc_se"), zero.alias("signal_variance"), zero.alias("total_variance"), F.col("agreement").isNotNull().alias("available"), F.lit(None).cast("string").alias("reason"), "decision_diversity")
    rows = simulate.latent_pairs(spark, design, sizes, components, replications, seed)
    p = N.ordinal_logit(F.col("y"), thresholds)
    names = [f"p{i}" for i in range(len(levels))]
    probs = rows.select(F.struct("replication", F.col(design.object).alias("object")).alias("unit"), "panel", *[c.alias(n) for c, n in zip(p, names, strict=True)])
    half = [votes.item_moments(probs.where(F.col("panel") == k), "unit", names, numbers) for k in (1, 2)]
    ratio = votes.score_ratio(*half, "unit") if numbers else votes.vector_ratio(*half, "unit", names)
    ok = (F.col("total_variance") > 0) & (F.col("signal_variance") > 0)
    reason = F.when(~(F.col("total_variance") > 0), "no total variance").when(~(F.col("signal_variance") > 0), "no signal variance")
    return ratio.select(F.lit(target).alias("target"), F.when(ok, F.least(F.lit(1.0), F.col("raw_estimate"))).alias("estimate"), "raw_estimate", "mc_se", "signal_variance", "total_variance", ok.alias("available"), reason.alias("reason"), F.lit(None).cast("double").alias("decision_diversity"))


def categorical_plan(spark: SparkSession, design: Design, grid: list[dict[str, int]], components: dict[str, float], thresholds: list[float], levels: list[str], cost, target: float, kind: str = "decision_agreement", n_items: int = 100, replications: int = 10, seed: int = 1, max_rows: int = 10_000_000) -> DataFrame:
    """design_id, allocation_*, total_cost, estimate, mc_se, meets_target, minimum_cost, pareto: point screening of simulated targets over a bounded grid."""
    from . import planning

    if sum(target_rows(n_items, c, replications, max_rows) for c in grid) > max_rows:
        raise SpecError("the plan's simulated rows exceed max_rows")
    parts = []
    for n, counts in enumerate(grid, 1):
        t = categorical_target(spark, design, counts, components, thresholds, levels, kind, None, n_items, replications, seed, max_rows)
        parts.append(t.select(F.lit(n).cast("long").alias("design_id"), *[F.lit(v).cast("long").alias(f"allocation_{f}") for f, v in counts.items()], "estimate", "mc_se", "available"))
    table = reduce(DataFrame.unionByName, parts).withColumn("feasible", F.lit(True))
    costed = planning.add_costs(table, cost, "USD", "2026-01-31")
    return planning.pareto(planning.screen(costed, target, F.col("estimate")))


def simulated_from(fit: Fit, spark: SparkSession, n_items: int, counts: dict[str, int], seed: int = 1, means: dict[str, float] | None = None, max_rows: int = 1_000_000) -> DataFrame:
    """A new panel with the fit's components (all outcomes, their covariances included): new items and facet levels."""
    sizes = {fit.design.object: n_items} | counts
    return simulate.joint_panel(spark, fit.design, sizes, fit.components, fit.outcomes, means, seed, max_rows)
