"""Queries of the fitting, simulation and resampling operators (rows-only checks; tests hold them against dense oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import spec as S
from ..operators import audit, discrete, fit, methods, preflight, resampling, simulate, studies
from ..sources import panels as P

AXES = ["p_brand", "l_returnflag", "l_linestatus"]


def reml_fit(spark, d):
    f = fit.fit_gaussian(P.price_panel(spark, d), formula="price ~ p_brand * l_returnflag * l_linestatus")
    return f.table(spark)


def ml_fit_joint(spark, d):
    f = fit.fit_gaussian(P.price_panel(spark, d), formula="cbind(price, quantity) ~ p_brand * l_returnflag * l_linestatus", estimator="ML")
    return f.table(spark)


def reliability_intervals(spark, d):
    f = fit.fit_gaussian(P.price_panel(spark, d), formula="price ~ p_brand * l_returnflag * l_linestatus")
    rows = []
    for a in (1, 2, 3):
        for b in (1, 2):
            g, se = fit.coefficient(f, {"l_returnflag": a, "l_linestatus": b})
            rows.append((a, b, g, se))
    from ..operators.reliability import logit_interval

    t = spark.createDataFrame(rows, "l_returnflag int, l_linestatus int, Erho2 double, Erho2_se double")
    lo, hi = logit_interval(F.col("Erho2"), F.col("Erho2_se"))
    return t.withColumns({"Erho2_lower": lo, "Erho2_upper": hi})


def observed_row_fit(spark, d):
    """Nation by order priority: all orders averaged into at most 125 cells, some of which may be missing."""
    o = P.table(spark, d, "orders").join(P.table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = P.cell_means(o, ["c_nationkey", "o_orderpriority"], {"value": "o_totalprice"}).collect()
    design = S.design("c_nationkey", ["o_orderpriority"]).resolve("gaussian")
    at, dev = fit.fit_observed([(r["c_nationkey"], r["o_orderpriority"]) for r in rows], [r["value"] / 1000 for r in rows], design)
    return spark.createDataFrame([(s, v, dev) for s, v in at.items()], "source string, component double, deviance double")


# ------------------------------------------------- discrete fits of table columns

BY_SOURCE = S.design("source", ["lang"], full_cell=False)
BY_NATION = S.design("nation", ["year"], full_cell=False)
BY_HOUR = S.design("hour", ["dow"], full_cell=False)
FLAG = S.Family("binary", "logit", (0, 1))
PRIORITY = S.Family("ordinal", "logit", ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"))
EVENT = S.Family("categorical", None, ("click", "error", "purchase", "signup", "view"))


def judged(spark, d):
    """Labelled documents: source, lang, quality, toxic."""
    return P.table(spark, d, "documents").select("doc_id", "source", "lang").join(P.table(spark, d, "labels"), "doc_id").where("source IS NOT NULL AND lang IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select("source", "lang", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))


def prioritised(spark, d):
    """Orders: nation of the customer, year, priority."""
    o = P.table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("label"))
    c = P.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("nation", "year", "label")


def timed(spark, d):
    """Events: hour, weekday, kind."""
    return P.event_hours(spark, d).select("hour", "dow", F.col("event_type").alias("label"))


def _laplace(spark, f):
    return f.table(spark).withColumns({"nll": F.lit(f.nll), "accepted": F.lit(f.accepted)})


def laplace_fit_binary(spark, d):
    return _laplace(spark, discrete.fit_discrete(judged(spark, d), BY_SOURCE, "quality", FLAG))


def laplace_fit_joint(spark, d):
    """Two outcomes that share their sources, with their covariances."""
    return _laplace(spark, discrete.fit_discrete(judged(spark, d), BY_SOURCE, ["quality", "toxic"], [FLAG, FLAG], covariance={"lang": "diagonal"}))


def laplace_fit_ordinal(spark, d):
    return _laplace(spark, discrete.fit_discrete(prioritised(spark, d), BY_NATION, "label", PRIORITY))


LARGE = S.design("item", ["evaluator", "prompt"], random=["item", "evaluator", "prompt", "item:evaluator", "item:prompt", "evaluator:prompt"], replicates=18)
LARGE_AT = {"item": 1.44, "evaluator": 0.25, "prompt": 0.09, "item:evaluator": 0.36, "item:prompt": 0.16, "evaluator:prompt": 0.09}


def laplace_fit_large(spark, d):
    """An ordinal fit of 21,600 simulated rows with 819 random effects and 8 parameters (reads no table: it times the engine)."""
    sizes = {"item": 100, "evaluator": 4, "prompt": 3, "temp": 6, "seed": 3}
    latent = simulate.gaussian_panel(spark, S.design("item", ["evaluator", "prompt", "temp", "seed"], random=list(LARGE.terms)), sizes, LARGE_AT, seed=6)
    panel = simulate.ordinal_panel(latent, [-1.0, 1.0], ["low", "mid", "high"], 8, list(sizes))
    return _laplace(spark, discrete.fit_discrete(panel, LARGE, "label", S.Family("ordinal", "logit", ("low", "mid", "high"))))


def laplace_fit_nominal(spark, d):
    return _laplace(spark, discrete.fit_discrete(timed(spark, d), BY_HOUR, "label", EVENT))


def laplace_check(spark, d):
    f = discrete.fit_discrete(judged(spark, d), BY_SOURCE, "quality", FLAG)
    return discrete.laplace_check(spark, f, 5000, 3)


def discrete_diagnostics(spark, d):
    return methods.diagnostics(spark, discrete.fit_discrete(judged(spark, d), BY_SOURCE, "quality", FLAG)).drop("reason")


def preflight_discrete(spark, d):
    return preflight.as_table(spark, preflight.discrete_checks(prioritised(spark, d), BY_NATION, ["label"], [PRIORITY])).drop("detail")


def preflight_observed(spark, d):
    return preflight.as_table(spark, preflight.observed_checks(P.event_hours(spark, d), S.design("event_type", ["hour", "dow"], full_cell=False))).drop("detail")


def source_pairs(spark, d):
    return preflight.source_pairs(P.event_hours(spark, d), S.design("event_type", ["hour", "dow"], full_cell=False))


# ------------------------------------------------- studies of table panels

PRICE = S.design("p_brand", ["l_returnflag", "l_linestatus"]).resolve("gaussian")
COUNTS = {"l_returnflag": 3, "l_linestatus": 2}


def _price_fit(spark, d):
    panel = P.price_panel(spark, d).cache()
    return panel, fit.fit_gaussian(panel, ["price"], PRICE)


def fitted_dstudy(spark, d):
    """Coefficients of the fit with errors and bounds over a grid, composite included."""
    f = fit.fit_gaussian(P.price_panel(spark, d), ["price", "quantity"], PRICE)
    grid = [{"l_returnflag": a, "l_linestatus": b} for b in (1, 2) for a in (1, 2, 3)]
    return fit.fitted_table(spark, f, grid, {"both": S.Score({"price": 1.0, "quantity": 2.0})}, observed=COUNTS)


def fit_summary(spark, d):
    return methods.summary(spark, _price_fit(spark, d)[1])


def bootstrap_fit(spark, d):
    panel, f = _price_fit(spark, d)
    records = studies.bootstrap(panel, PRICE, ["price"], COUNTS, 60, 17, 70)
    estimates = {f"component_{s}_price": float(m[0, 0]) for s, m in f.components.items()}
    for kind in ("Erho2", "Phi"):
        estimates[kind] = fit.coefficient(f, COUNTS, "price", kind=kind)[0]
    return studies.intervals(records, estimates)


def _components(spark, d):
    return {s: float(m[0, 0]) for s, m in _price_fit(spark, d)[1].components.items()}


GRID = [{"l_returnflag": 2, "l_linestatus": 2}, {"l_returnflag": 4, "l_linestatus": 2}]


def pilot_plan(spark, d):
    """Pilots with the price panel's fitted components: interval widths of two allocations."""
    return resampling.pilot_summary(studies.pilot(spark, PRICE, GRID, 30, _components(spark, d), 20, 2), 0.1)


def pilot_target(spark, d):
    """The same pilots against the coefficient that their components have."""
    at = _components(spark, d)
    return studies.pilot_target_summary(studies.pilot(spark, PRICE, GRID, 30, at, 20, 2), studies.reference_coefficients(spark, PRICE, GRID, at))


def simulate_panel(spark, d):
    """A new panel with the components that the price panel was fitted with."""
    return studies.simulated_from(_price_fit(spark, d)[1], spark, 24, {"l_returnflag": 4, "l_linestatus": 2}, 3)


def _ordinal(spark, d):
    f = discrete.fit_discrete(prioritised(spark, d), BY_NATION, "label", PRIORITY)
    return {s: max(v, 0.05) for s, v in f.variances.items()}, [float(t) for t in f.thresholds]


def categorical_target(spark, d):
    """Three targets of the fitted ordinal outcome, from pairs of simulated panels."""
    at, cuts = _ordinal(spark, d)
    parts = [studies.categorical_target(spark, BY_NATION, {"year": 5}, at, cuts, list(PRIORITY.levels), t, None, 50, 10, 4) for t in ("decision_agreement", "observed_score", "category_vector")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def categorical_plan(spark, d):
    at, cuts = _ordinal(spark, d)
    cost = {"annotation": 0.05 * F.col("allocation_year")}
    return studies.categorical_plan(spark, BY_NATION, [{"year": n} for n in (2, 4, 8)], at, cuts, list(PRIORITY.levels), cost, 0.5, "observed_score", 40, 5, 6)


def kernel_rank(spark, d):
    rank, n = audit.kernel_rank(P.event_panel(spark, d), S.design("user_id", ["event_type"], full_cell=False))
    return spark.createDataFrame([(rank, n)], "rank int, sources int")


def queries() -> dict:
    every = (
        reml_fit, ml_fit_joint, reliability_intervals, observed_row_fit, laplace_fit_binary, laplace_fit_joint, laplace_fit_ordinal, laplace_fit_large, laplace_fit_nominal, laplace_check, discrete_diagnostics,
        preflight_discrete, preflight_observed, source_pairs, fitted_dstudy, fit_summary, bootstrap_fit, pilot_plan, pilot_target, simulate_panel, categorical_target, categorical_plan, kernel_rank,
    )
    return {f.__name__: f for f in every}
