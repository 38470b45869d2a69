"""Registered queries of the panel operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import spec as S
from ..functions import numeric as N
from ..operators import audit, batches, planning, reliability, resampling, strata, votes
from ..sources import panels as P
from . import sql, sql_more

AXES = ["p_brand", "l_returnflag", "l_linestatus"]
FLAGSHIP = S.design("p_brand", ["l_returnflag", "l_linestatus"]).resolve("gaussian")
HOURS = ["event_type", "hour", "dow"]
#: Design of the planning queries.
STUDY_DESIGN = S.design("item", ["rater", "occasion"]).resolve("gaussian")


def r(c: Column | str, k: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), k) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, k: int = 6) -> DataFrame:
    return df.withColumns({n: r(n, k) for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def components(spark: SparkSession, values: dict[str, float], outcome: str = "y") -> DataFrame:
    return spark.createDataFrame([(s, outcome, outcome, v) for s, v in values.items()], "source string, row string, col string, component double")


def flagship_components(spark, d) -> DataFrame:
    return strata.moment_components(P.price_panel(spark, d), ["price"], AXES).select("source", "row", "col", "component")


# ------------------------------------------------- audit


def panel_completeness(spark, d):
    return longs(audit.completeness(P.event_hours(spark, d), HOURS), "rows", "observed_cells", "expected_cells", "min_rows", "max_rows")


def panel_cell_status(spark, d):
    return audit.cell_status(P.event_hours(spark, d), HOURS)


def panel_missing_cells(spark, d):
    return audit.missing_cells(P.event_hours(spark, d), HOURS, 20)


def panel_replication_issues(spark, d):
    return longs(audit.replication_issues(P.event_hours(spark, d), HOURS, 1, 20), "rows")


def level_counts(spark, d):
    return longs(audit.level_counts(P.table(spark, d, "lineitem"), ["l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]), "levels")


SUPPLY = S.design("l_suppkey", ["l_linenumber", "l_returnflag"], full_cell=False)


def source_group_counts(spark, d):
    return longs(audit.sources_table(P.table(spark, d, "lineitem"), SUPPLY), "observed_groups", "predictor_dimensions", "random_dimension", "covariance_parameters")


def kernel_gram(spark, d):
    return audit.kernel_gram(P.event_panel(spark, d), S.design("user_id", ["event_type"], full_cell=False))


def preflight_checks(spark, d):
    return audit.preflight_gaussian(P.price_panel(spark, d), FLAGSHIP, ["price", "quantity"])


def preflight_incomplete(spark, d):
    return audit.preflight_gaussian(P.event_hours(spark, d), S.design("event_type", ["hour", "dow"], full_cell=False), ["value"])


def outcome_profile_numeric(spark, d):
    return rounded(longs(audit.numeric_profile(P.table(spark, d, "events"), "value"), "n", "n_distinct"), "min", "max", "mean", "sd", k=4)


def outcome_profile_categories(spark, d):
    docs = P.table(spark, d, "documents").join(P.table(spark, d, "labels"), "doc_id")
    return rounded(longs(audit.category_profile(docs, "lang", ["de", "en", "es", "fr", "it"]), "n"), "proportion")


def category_coverage(spark, d):
    e = P.event_hours(spark, d)
    return rounded(longs(audit.category_coverage(e, "event_type", [["hour"], ["hour", "dow"]]), "groups_with_category", "groups"), "coverage")


def no_variation_groups(spark, d):
    docs = P.table(spark, d, "documents").join(P.table(spark, d, "labels"), "doc_id")
    return longs(audit.no_variation_groups(docs, "quality", [["source"], ["source", "lang"]]), "groups", "no_variation", "single_row")


def null_counts(spark, d):
    return longs(audit.null_counts(P.table(spark, d, "events"), ["user_id", "event_type", "value"]), "user_id", "event_type", "value")


def data_identity(spark, d):
    return audit.data_identity(P.table(spark, d, "events"), ["user_id", "event_type", "value"])


# ------------------------------------------------- codings

PRIORITY = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


def _orders(spark, d):
    return P.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")


def encode_ordinal(spark, d):
    return _orders(spark, d).select("o_orderkey", P.encode_ordinal(F.col("o_orderpriority"), PRIORITY).alias("code"))


def encode_binary(spark, d):
    return P.table(spark, d, "events").select("event_id", P.encode_binary((F.col("event_type") == "purchase")).alias("code"))


def encode_nominal(spark, d):
    return P.table(spark, d, "events").select("event_id", P.encode_nominal(F.col("event_type"), ["click", "error", "purchase", "signup", "view"]).alias("label"))


def working_score_map(spark, d):
    return _orders(spark, d).select("o_orderkey", P.working_score(F.col("o_orderpriority"), {p: i for i, p in enumerate(PRIORITY)}).alias("score"))


def flag_groups(spark, d):
    o = _orders(spark, d)
    flag = lambda c: P.encode_binary(c)
    return o.select("o_orderkey", P.any_flag(flag(F.col("o_orderpriority") == "1-URGENT"), flag(F.col("o_orderpriority") == "2-HIGH")).alias("pressing"), P.any_flag(flag(F.col("o_orderstatus") == "O"), flag(F.col("o_totalprice") > 100000)).alias("open_or_large"))


def example_catalog(spark, d):
    return P.example_catalog(spark)


# ------------------------------------------------- strata


def strata_ss(spark, d):
    return rounded(strata.strata(P.price_panel(spark, d), ["price"], AXES).select("mask", "df", "sscp"), "sscp", k=4)


def strata_sscp_joint(spark, d):
    return rounded(strata.strata(P.price_panel(spark, d), ["price", "quantity"], AXES).select("mask", "row", "col", "df", "sscp"), "sscp", k=4)


def moment_components(spark, d):
    return rounded(strata.moment_components(P.price_panel(spark, d), ["price"], AXES), "component", k=5)


def moment_components_joint(spark, d):
    return rounded(strata.moment_components(P.price_panel(spark, d), ["price", "quantity"], AXES), "component", k=5)


def moment_components_embeddings(spark, d):
    return rounded(strata.moment_components(P.embedding_panel(spark, d), ["v"], ["vec_id", "hi", "lo"]), "component", k=8)


DEVIANCE_AT = {"p_brand": 400.0, "l_returnflag": 5.0, "l_linestatus": 5.0, "p_brand:l_returnflag": 20.0, "p_brand:l_linestatus": 20.0, "l_returnflag:l_linestatus": 2.0, "Residual": 60.0}


def gaussian_deviance_given_components(spark, d):
    s = strata.strata(P.price_panel(spark, d), ["price"], AXES)
    both = [strata.deviance(s, DEVIANCE_AT, AXES, reml).select(F.lit(name).alias("estimator"), "deviance") for name, reml in (("REML", True), ("ML", False))]
    return rounded(both[0].unionByName(both[1]), "deviance", k=4)


def component_correlations(spark, d):
    c = strata.moment_components(P.price_panel(spark, d), ["price", "quantity"], AXES).select("source", "row", "col", "component")
    return rounded(strata.correlations(c), "correlation", k=5)


# ------------------------------------------------- reliability


def _flag_grid(spark):
    return reliability.allocation_grid(spark, {"l_returnflag": [3], "l_linestatus": [2]})


def reliability_g_phi(spark, d):
    c = reliability.coefficients(reliability.source_weights(_flag_grid(spark), FLAGSHIP), flagship_components(spark, d))
    return rounded(c.select("outcome", "universe_variance", "relative_error", "absolute_error", "Erho2", "Phi"), "universe_variance", "relative_error", "absolute_error", "Erho2", "Phi", k=5)


def reliability_fixed_facet(spark, d):
    c = reliability.coefficients(reliability.source_weights(_flag_grid(spark), FLAGSHIP, ("l_linestatus",), {"l_returnflag": 3, "l_linestatus": 2}), flagship_components(spark, d))
    return rounded(c.select("outcome", "Erho2", "Phi"), "Erho2", "Phi", k=5)


def reliability_composite(spark, d):
    joint = strata.moment_components(P.price_panel(spark, d), ["price", "quantity"], AXES).select("source", "row", "col", "component")
    c = reliability.coefficients(reliability.source_weights(_flag_grid(spark), FLAGSHIP), reliability.score_components(joint, {"price": 1.0, "quantity": 2.0}), "composite")
    return rounded(c.select("kind", "outcome", "Erho2", "Phi"), "Erho2", "Phi", k=5)


def source_weights(spark, d):
    grid = reliability.allocation_grid(spark, {"rater": [2, 4], "occasion": [1, 2]})
    return rounded(reliability.source_weights(grid, STUDY_DESIGN).select("design_id", "source", "universe", "relative", "absolute", "role"), "universe", "relative", "absolute")


def _study(spark, d):
    """Allocations of the price panel, brands as items, flags as raters, status as occasions."""
    panel = P.price_panel(spark, d).withColumnsRenamed({"p_brand": "item", "l_returnflag": "rater", "l_linestatus": "occasion", "price": "y"})
    grid = reliability.allocation_grid(spark, {"rater": [1, 2, 3, 4], "occasion": [1, 2, 3]})
    c = strata.moment_components(panel, ["y"], ["item", "rater", "occasion"]).select("source", "row", "col", F.greatest(F.lit(0.0), F.col("component")).alias("component"))
    return reliability.source_weights(grid, STUDY_DESIGN), c


def dstudy_grid(spark, d):
    w, c = _study(spark, d)
    return rounded(longs(reliability.reporting(reliability.coefficients(w, c), STUDY_DESIGN, {"rater": 2, "occasion": 2}).select("design_id", "allocation_rater", "allocation_occasion", "Erho2", "Phi", "measurements_per_object", "extrapolated"), "allocation_rater", "allocation_occasion"), "Erho2", "Phi", "measurements_per_object")


def dstudy_flagship(spark, d):
    grid = reliability.allocation_grid(spark, {"l_returnflag": [1, 2, 3, 6], "l_linestatus": [1, 2, 4]})
    c = reliability.coefficients(reliability.source_weights(grid, FLAGSHIP), flagship_components(spark, d))
    return rounded(longs(c.select("design_id", "l_returnflag", "l_linestatus", "Erho2", "Phi"), "l_returnflag", "l_linestatus"), "Erho2", "Phi", k=5)


def dstudy_target(spark, d):
    w, c = _study(spark, d)
    t = reliability.reporting(reliability.coefficients(w, c), STUDY_DESIGN, {"rater": 2, "occasion": 2})
    return rounded(reliability.dstudy_target(t, 0.95).select("design_id", "estimate", "meets_target", "fewest_measurements"), "estimate")


NESTED = S.design("person", ["item", "question"], crossed=["question"], nested={"item": "question"}, item_nested=["item"]).resolve("gaussian")
NESTED_AT = {"person": 1.0, "question": 0.2, "question:item": 0.1, "item:question": 0.1, "person:question": 0.3, "Residual": 0.8}


def dstudy_nested(spark, d):
    grid = reliability.allocation_grid(spark, {"item": [3, 6], "question": [2, 4]})
    at = {s: NESTED_AT[s] for s in [*NESTED.terms, "Residual"]}
    return rounded(longs(reliability.coefficients(reliability.source_weights(grid, NESTED), components(spark, at)).select("design_id", "item", "question", "Erho2", "Phi"), "item", "question"), "Erho2", "Phi")


def coefficient_interval_logit(spark, d):
    w, c = _study(spark, d)
    t = reliability.coefficients(w, c).withColumn("se", F.lit(0.05) / F.col("rater"))
    lo, hi = reliability.logit_interval(F.col("Erho2"), F.col("se"), 0.95)
    return rounded(t.select("design_id", lo.alias("lower"), hi.alias("upper")), "lower", "upper")


# ------------------------------------------------- planning


def _plan(spark, d):
    w, c = _study(spark, d)
    t = reliability.reporting(reliability.coefficients(w, c), STUDY_DESIGN, {"rater": 2, "occasion": 2})
    t = t.withColumns({"annotations_per_item": F.col("measurements_per_object"), "study_items": F.lit(20), "total_annotations": F.col("measurements_per_object") * 20})
    return planning.add_costs(t, {"annotation": 0.05 * F.col("total_annotations"), "raters": 2.0 * F.col("allocation_rater"), "setup": F.lit(3.0)}, "USD", "2026-01-31")


def plan_costs(spark, d):
    t = _plan(spark, d)
    return rounded(t.select("design_id", "total_annotations", "cost_component_annotation", "cost_component_raters", "cost_component_setup", "total_cost", "currency"), "total_annotations", "cost_component_annotation", "cost_component_raters", "cost_component_setup", "total_cost")


def _checked(spark, d):
    unknown = F.when(F.col("allocation_occasion") == 3, F.lit(None).cast("boolean")).otherwise(F.lit(True))
    return planning.constraints(_plan(spark, d), {"within_budget": F.col("total_cost") <= 20, "staffed": unknown})


def plan_constraints(spark, d):
    return _checked(spark, d).select("design_id", "feasible", "constraint_reason")


def plan_minimum_cost(spark, d):
    t = planning.screen(_checked(spark, d), 0.95, F.col("Erho2"))
    return longs(t.select("design_id", "meets_target", "eligible", "minimum_cost", F.coalesce("cost_rank", F.lit(0)).alias("cost_rank")), "cost_rank")


def plan_pareto(spark, d):
    return planning.pareto(planning.screen(_checked(spark, d), 0.95, F.col("Erho2"))).select("design_id", "feasible", "pareto")


def plan_baseline(spark, d):
    t = planning.against_baseline(_plan(spark, d), 1)
    names = ["extra_cost", "relative_error_reduction", "absolute_error_reduction", "Erho2_gain", "Phi_gain"]
    return rounded(t.select("design_id", *names), *names)


def plan_source_contributions(spark, d):
    w, c = _study(spark, d)
    t = planning.source_contributions(w, c, 1, "y")
    return rounded(t, "universe", "relative_error", "absolute_error", "relative_error_reduction", "absolute_error_reduction")


# ------------------------------------------------- batches


def _supply_rows(spark, d):
    li = P.table(spark, d, "lineitem")
    return P.cell_means(li, ["l_suppkey", "l_returnflag"], {"y": "l_quantity"}).withColumn("call", F.concat_ws("/", F.floor(F.col("l_suppkey") / 5).cast("long"), "l_returnflag"))


def batch_inferred(spark, d):
    return batches.inferred(P.table(spark, d, "supplier"), "s_suppkey", "s_acctbal", 5).withColumnRenamed("item", "s_suppkey")


def batch_problems(spark, d):
    return longs(batches.inferred_problems(P.table(spark, d, "lineitem"), "l_suppkey", "l_linenumber"), "varying_items", "tied_items")


def batch_recorded(spark, d):
    return longs(batches.recorded(_supply_rows(spark, d), "l_suppkey", "call", "l_suppkey").select("call", "l_suppkey", "position"), "position")


def batch_audit(spark, d):
    return longs(batches.recorded_audit(_supply_rows(spark, d), "l_suppkey", "call", ["l_returnflag"], "l_suppkey", 5), "calls", "batches", "spanning", "repeated", "oversized", "tied", "largest")


def call_groups(spark, d):
    return longs(batches.call_groups(_supply_rows(spark, d), "l_suppkey", "call", ["l_returnflag"]), "rows", "items", "conditions")


def _layout(spark, d):
    return P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("item"), (F.floor(F.col("s_suppkey") / 5) + 1).cast("long").alias("batch"))


def batch_eligibility(spark, d):
    return longs(batches.eligibility(_layout(spark, d), _supply_rows(spark, d), ["l_suppkey", "l_returnflag"], 5), "batches")


BATCH_DESIGN = S.design("item", ["rater"]).resolve("gaussian")
BATCH_AT = {"item": 1.5, "rater": 0.3, "Call": 0.4, "Residual": 0.6}


def _kernels(spark, counts, design_id=None):
    rows = batches.kernels(BATCH_DESIGN, counts)
    return spark.createDataFrame([(design_id or 1, *x) for x in rows], "design_id long, source string, kernel string, divisor double, role string")


def _targets(spark, d, kind):
    items = _layout(spark, d).select("item")
    if kind == "absolute_item":
        return items.select(F.concat(F.lit("item:"), F.col("item").cast("string")).alias("target"), F.lit(kind).alias("target_kind"), "item", F.lit(1.0).alias("weight"))
    if kind == "contrast":
        return spark.createDataFrame([("contrast:1-7", kind, 1, 1.0), ("contrast:1-7", kind, 7, -1.0), ("contrast:1-2", kind, 1, 1.0), ("contrast:1-2", kind, 2, -1.0)], "target string, target_kind string, item long, weight double")
    n = items.agg(F.count("*").alias("n"))
    return items.crossJoin(F.broadcast(n)).select(F.lit("aggregate:all").alias("target"), F.lit(kind).alias("target_kind"), "item", (1.0 / F.col("n")).alias("weight"))  # n: one row


def _batch(spark, d, kind, kernels=None):
    c = batches.contractions(_targets(spark, d, kind), _layout(spark, d))
    return batches.batch_contributions(c, kernels if kernels is not None else _kernels(spark, {"rater": 4}), components(spark, BATCH_AT))


SUMMARY = ["universe_variance", "error_variance", "error_sd", "coefficient"]


def batch_item_reliability(spark, d):
    return rounded(batches.batch_summary(_batch(spark, d, "absolute_item")).drop("design_id"), *SUMMARY)


def batch_contrast(spark, d):
    return rounded(batches.batch_summary(_batch(spark, d, "contrast")).drop("design_id"), *SUMMARY)


def batch_aggregate(spark, d):
    return rounded(_batch(spark, d, "aggregate").select("target", "source", "kernel", "role", "contraction", "divisor", "variance"), "contraction", "divisor", "variance", k=8)


def batch_dstudy(spark, d):
    grids = [_kernels(spark, {"rater": n}, n) for n in (1, 2, 4, 8)]
    k = grids[0]
    for x in grids[1:]:
        k = k.unionByName(x)
    return rounded(batches.batch_summary(_batch(spark, d, "contrast", k)), *SUMMARY)


# ------------------------------------------------- categorical targets


def _halves(spark, d):
    e = P.table(spark, d, "events").select("event_id", "user_id", "event_type")
    return e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")


def plurality_votes(spark, d):
    return rounded(longs(votes.plurality_votes(P.table(spark, d, "events"), "user_id", "event_type"), "votes"), "share")


def decision_agreement(spark, d):
    return rounded(longs(votes.decision_agreement(*_halves(spark, d), "user_id", "event_type"), "items"), "agreement", "decision_diversity")


def _probabilities(df):
    p = N.ordinal_logit(F.col("x"), [-0.5, 0.7])
    return df.select("item", "x", *[c.alias(f"p{i + 1}") for i, c in enumerate(p)])


def _eta(spark, d, odd=None):
    e = P.table(spark, d, "events")
    e = e if odd is None else e.where(F.col("event_id") % 2 == odd)
    return e.select(F.col("user_id").alias("item"), ((F.col("event_id") % 17) / 8.0 - 1 + (F.col("user_id") % 5) / 4.0).alias("x"))


def category_moments(spark, d):
    m = votes.item_moments(_probabilities(_eta(spark, d)), "item", ["p1", "p2", "p3"])
    return rounded(m, "p1", "p2", "p3", "second")


def score_ratio(spark, d):
    half = [votes.item_moments(_probabilities(_eta(spark, d, k)), "item", ["p1", "p2", "p3"], [1.0, 2.0, 4.0]) for k in (0, 1)]
    return rounded(votes.score_ratio(*half, "item"), "signal_variance", "total_variance", "raw_estimate", "mc_se")


def replicate_agreement(spark, d):
    return rounded(longs(votes.replicate_agreement(P.table(spark, d, "lineitem"), ["l_suppkey", "l_linenumber"], "l_returnflag", "l_linestatus"), "cells"), "agreement")


def binary_probabilities(spark, d):
    g = spark.range(41).select(F.col("id"), ((F.col("id") - 20) / 4.0).alias("eta"))
    return rounded(g.select("id", N.logistic(F.col("eta")).alias("p")), "p", k=9)


def ordinal_probabilities_logit(spark, d):
    g = spark.range(41).select(F.col("id"), ((F.col("id") - 20) / 4.0).alias("eta"))
    p = N.ordinal_logit(F.col("eta"), [-1.0, 0.25, 2.0])
    return rounded(g.select("id", *[c.alias(f"p{i + 1}") for i, c in enumerate(p)]), "p1", "p2", "p3", "p4", k=9)


def softmax_probabilities(spark, d):
    g = spark.range(41).select(F.col("id"), ((F.col("id") - 20) / 4.0).alias("a"), (F.col("id") % 7 / 2.0).alias("b"))
    p = N.softmax([F.lit(0.0), F.col("a"), F.col("b")])
    return rounded(g.select("id", *[c.alias(f"p{i + 1}") for i, c in enumerate(p)]), "p1", "p2", "p3", k=9)


def inverse_cdf_labels(spark, d):
    e = P.table(spark, d, "events").select("event_id", ((F.col("event_id") * 7919 % 10007) / 10007.0).alias("u"), (F.col("user_id") % 9 / 3.0 - 1).alias("eta"))
    p = N.ordinal_logit(F.col("eta"), [-0.6, 0.4])
    return e.select("event_id", N.inverse_cdf_label(F.col("u"), p, ["low", "mid", "high"]).alias("label"))


# ------------------------------------------------- resampling


def _records(spark, d):
    return P.table(spark, d, "orders").select((F.col("o_custkey") % 6).alias("component"), (F.col("o_totalprice") / 1000).alias("value"))


def bootstrap_resample(spark, d):
    s = P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("item"), "s_nationkey")
    n = s.count()
    drawn = spark.range(3 * n).select((F.floor(F.col("id") / n) + 1).cast("long").alias("attempt"), (F.col("id") % n).cast("long").alias("position"), (F.col("id") * 7919 % n + 1).cast("long").alias("item"))
    return longs(resampling.resample(s, drawn, "item").groupBy("attempt", "s_nationkey").agg(F.count("*").alias("n"), F.sum("item").alias("positions")), "n", "positions")


def percentile_interval_type6(spark, d):
    return rounded(resampling.intervals(_records(spark, d), ["component"], "value", 0.9), "se", "lower", "upper", k=3)


def jackknife_acceleration(spark, d):
    return rounded(resampling.acceleration(_records(spark, d), ["component"], "value"), "acceleration", k=7)


def pilot_summary(spark, d):
    o = P.table(spark, d, "orders")
    k = F.col("o_orderkey") % 11
    status = F.when(k < 6, "accepted").when(k == 6, "fit_error").when(k == 7, "simulation_error").when(k == 8, "numerically_refused").when(k == 9, "interval_unavailable").otherwise("reliability_error")
    rec = o.select((F.col("o_custkey") % 4).alias("design_id"), status.alias("status"), F.col("o_totalprice").alias("w")).withColumns({"accepted": F.col("status").isin("accepted", "interval_unavailable"), "interval_available": F.col("status") == "accepted", "width": F.col("w") / 500000})
    s = resampling.pilot_summary(rec, 0.3)
    ints = ["attempted", "accepted", "preparation_or_fit_errors", "simulation_errors", "refused", "reliability_errors", "interval_available", "interval_unavailable", "precision_successes"]
    reals = [c for c in s.columns if c not in (*ints, "design_id")]
    return rounded(longs(s, *ints), *reals)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: panel, strata, moment components, weights and coefficients in one plan."""
    return reliability_g_phi(spark, sf_dir)


_PLAIN = [
    panel_completeness, panel_cell_status, panel_missing_cells, panel_replication_issues, level_counts, source_group_counts, kernel_gram, preflight_checks, preflight_incomplete,
    outcome_profile_numeric, outcome_profile_categories, category_coverage, no_variation_groups, null_counts, data_identity,
    encode_ordinal, encode_binary, encode_nominal, working_score_map, flag_groups, example_catalog,
    strata_ss, strata_sscp_joint, moment_components, moment_components_joint, moment_components_embeddings, gaussian_deviance_given_components, component_correlations,
    reliability_g_phi, reliability_fixed_facet, reliability_composite, source_weights, dstudy_grid, dstudy_flagship, dstudy_target, dstudy_nested, coefficient_interval_logit,
    plan_costs, plan_constraints, plan_minimum_cost, plan_pareto, plan_baseline, plan_source_contributions,
    batch_inferred, batch_problems, batch_recorded, batch_audit, call_groups, batch_eligibility, batch_item_reliability, batch_contrast, batch_aggregate, batch_dstudy,
    plurality_votes, decision_agreement, category_moments, score_ratio, replicate_agreement, binary_probabilities, ordinal_probabilities_logit, softmax_probabilities, inverse_cdf_labels,
    bootstrap_resample, percentile_interval_type6, jackknife_acceleration, pilot_summary,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import model_queries

    return {f.__name__: f for f in _PLAIN} | model_queries.queries()


def oracle_sql() -> dict[str, str]:
    return sql.statements() | sql_more.statements()
