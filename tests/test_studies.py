"""Fits with options, calls as a source, preflight, bootstrap, pilots, targets and fit methods."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelgauge import spec as S
from panelgauge.operators import audit, batches, fit, methods, preflight, reliability, simulate, studies, votes
from panelgauge.sources import panels as P

TWO = S.design("item", ["rater"]).resolve("gaussian")
AT = {"item": 1.5, "rater": 0.3, "Residual": 0.8}


@pytest.fixture(scope="module")
def panel(spark):
    p = simulate.gaussian_panel(spark, TWO, {"item": 24, "rater": 4}, AT, seed=4)
    return p.withColumn("z", F.col("y") * 0.5 + F.col("item") % 3 + F.col("rater") % 2 * (F.col("item") % 5)).cache()


def test_strata_of_equals_the_plan(panel):
    p, q = studies.strata_of(studies.complete_array(panel.toPandas(), ["item", "rater"], ["y", "z"]), ["item", "rater"], ["y", "z"]), fit.prepare(panel, ["y", "z"], ["item", "rater"])
    assert p.df == q.df and p.levels == q.levels
    for m in (1, 2, 3):
        assert p.sscp[m] == pytest.approx(q.sscp[m], rel=1e-9)


def test_covariance_choices(panel):
    p = fit.prepare(panel, ["y", "z"], ["item", "rater"])
    free = fit.fit_prepared(p, TWO)
    diagonal = fit.fit_prepared(p, TWO, covariance={"rater": "diagonal"}, residual="pooled")
    assert free.accepted and diagonal.accepted and free.deviance < diagonal.deviance
    assert diagonal.components["rater"][0, 1] == 0 and free.parameters == 9 and diagonal.parameters == 3 + 2 + 1
    r = diagonal.components["Residual"]
    assert r[0, 0] == pytest.approx(r[1, 1]) and r[0, 1] == 0
    again = fit.fit_prepared(p, TWO, start=free.components)
    assert again.deviance == pytest.approx(free.deviance, abs=1e-6) and again.attempts[0][3]
    assert fit.independent_deviance(p, free.components, free.masks, True) == pytest.approx(free.deviance, rel=1e-10)
    for bad in ({"covariance": "banded"}, {"covariance": {"other": "diagonal"}}, {"residual": "free"}, {"start": {"item": np.eye(2)}}, {"start": {s: -np.eye(2) for s in free.components}}, {"control": S.Control(max_parameters=3)}):
        with pytest.raises(S.SpecError):
            fit.fit_prepared(p, TWO, **bad)


def test_methods(spark, panel):
    f = fit.fit_gaussian(panel, ["y"], TWO)
    assert methods.nobs(f) == 96 and methods.log_likelihood(f) == (-f.deviance / 2, 3) and methods.usable(f) == (True, "")
    assert {r["stage"]: r["status"] for r in methods.diagnostics(spark, f).collect()}["independent_objective"] == "passed"
    s = {r["source"]: r for r in methods.summary(spark, f).collect()}
    assert sum(r["share"] for r in s.values()) == pytest.approx(1) and s["item"]["se"] > 0
    names, v = methods.component_vcov(f)
    assert len(names) == len(v) and methods.attempts(spark, f).count() == 2
    for refused in (lambda: methods.vcov(f), lambda: methods.coef(f), lambda: methods.require_fit(3)):
        with pytest.raises(S.SpecError):
            refused()
    assert methods.retained(f, S.Control(retain=frozenset({"model"}))).attempts == [] and np.isnan(methods.retained(f, S.Control(retain=frozenset())).prepared.sscp[1]).all()
    assert methods.formula_of(TWO, ["y"]) == "y ~ item + rater" and "panel[" in methods.recorded_call("fit", panel=panel, design=TWO)
    assert methods.arguments("y ~ item * rater", panel)[1] == methods.arguments(panel, "y ~ item * rater")[1] == "y ~ item * rater" and methods.arguments(panel, ["y"])[2] == ["y"]
    assert methods.updated({"outcomes": ["y"], "measured": None}, formula="z ~ item * rater")["outcomes"] == ["z"]
    assert [methods.item_key(x) for x in (0.0, -0.0, 3, 3.0, 0.1, "a")] == ["0", "0", "3", "3", "0.10000000000000001", "a"]
    assert [methods.quoted(x) for x in ("a:b", "a b")] == ["a:b", "`a b`"]
    m = np.array([[1.0, 2.0], [2.0, 5.0]])
    assert methods.aligned(m, ["a", "b"], ["b", "a"])[0, 0] == 5 and (lambda r: r.T @ r)(methods.stratum_root(m)) == pytest.approx(m)


def test_fitted_table(spark, panel):
    f = fit.fit_gaussian(panel, ["y", "z"], TWO)
    t = {(r["design_id"], r["outcome"]): r for r in fit.fitted_table(spark, f, [{"rater": 2}, {"rater": 8}], {"sum": S.Score({"y": 1.0, "z": 1.0})}, observed={"rater": 4}).collect()}
    assert len(t) == 6 and t[2, "y"]["Erho2"] > t[1, "y"]["Erho2"] and t[2, "y"]["extrapolated"] and not t[1, "y"]["extrapolated"]
    for r in t.values():
        assert r["Erho2_lower"] < r["Erho2"] < r["Erho2_upper"] and r["Erho2_interval_available"] and r["uncertainty_source"] == "delta"
    with pytest.raises(S.SpecError):
        fit.fitted_table(spark, f, [{"rater": 2}], fixed=("rater",), observed={"rater": 4})


def test_call_as_a_source(spark):
    """Batches of four items share a call under each rater: its variance is found, and ordinary coefficients are refused."""
    rng = np.random.default_rng(6)
    i, r, c = rng.normal(0, 1.2, 40), rng.normal(0, 0.5, 6), rng.normal(0, 0.9, (10, 6))
    rows = [(a, b, float(i[a] + r[b] + c[a // 4, b] + rng.normal(0, 0.6))) for a in range(40) for b in range(6)]
    p = spark.createDataFrame(rows, "item long, rater int, y double")
    layout = spark.createDataFrame([(a, a // 4) for a in range(40)], "item long, batch int")
    d = S.design("item", ["rater"], batch=S.Batch(4))
    f = fit.fit_gaussian(p, ["y"], d, layout=layout)
    assert f.accepted and set(f.components) == {"item", "rater", "Call", "Residual"}
    assert f.components["Call"][0, 0] == pytest.approx(0.81, rel=0.5) and f.components["item"][0, 0] == pytest.approx(1.44, rel=0.6)
    # dense likelihood at the fitted components
    y = np.array([x[2] for x in rows])
    same = lambda k: np.array([[k(a) == k(b) for b in rows] for a in rows], float)
    v = sum(f.components[s][0, 0] * same(k) for s, k in (("item", lambda x: x[0]), ("rater", lambda x: x[1]), ("Call", lambda x: (x[0] // 4, x[1])))) + f.components["Residual"][0, 0] * np.eye(len(rows))
    inv, one = np.linalg.inv(v), np.ones(len(rows))
    mu = one @ inv @ y / (one @ inv @ one)
    dense = (len(rows) - 1) * np.log(2 * np.pi) + np.linalg.slogdet(v)[1] + np.log(one @ inv @ one) + (y - mu) @ inv @ (y - mu)
    assert f.deviance == pytest.approx(dense, abs=1e-6)
    with pytest.raises(S.SpecError, match="call is a source"):
        fit.coefficient(f, {"rater": 6})
    with pytest.raises(S.SpecError, match="can't be a source"):
        fit.fit_gaussian(p, ["y"], d, layout=layout.where("item < 30"))


def test_codings_stop_at_unknown_labels(spark):
    df = spark.createDataFrame([(" low ", "TRUE", "a", "3"), ("HIGH", "0", "b", "1")], "o string, f string, n string, s string")
    got = df.select(P.encode_ordinal(F.col("o"), ["low", "high"]), P.encode_binary(F.col("f")), P.encode_nominal(F.col("n"), ["a", "b"]), P.working_score(F.col("n"), {"a": 2, "b": 5}), P.encode_severity(F.col("s"), 3)).collect()
    assert [tuple(r) for r in got] == [(1, 1, "a", 2, 3), (2, 0, "b", 5, 1)]
    for c in (P.encode_ordinal(F.col("o"), ["low", "mid"]), P.encode_binary(F.col("o")), P.encode_nominal(F.col("n"), ["a"]), P.working_score(F.col("n"), {"a": 1}), P.encode_severity(F.col("s"), 2), P.encode_binary(F.lit(None))):
        with pytest.raises(Exception, match="unknown value"):
            df.select(c).collect()


def test_examples(spark, tmp_path):
    raw = "item_id,evaluator,prompt_type,temperature,seed,score,label,depression,anxiety,suicidal,stress,bipolar,personality_disorder,efficacy,safety,burden,cost\n"
    raw += "1,m,p,0.2,1,2, Normal ,true,0,FALSE,1,false,0,positive,NEUTRAL,negative,neutral\n2,m,p,0.2,1,3,SUICIDAL,0,1,1,0,1,0,neutral,neutral,positive,positive\n"
    path = tmp_path / "a.csv"
    path.write_text(raw)
    one = {n: P.read_example(spark, n, str(path)).orderBy("item").collect() for n in ("hate_speech", "drug_review_4aspect", "mental_health_3group", "mental_health_nominal", "mental_health_7L", "mental_health_3L", "mental_health_6flag")}
    assert [r["score"] for r in one["hate_speech"]] == [2, 3] and [r["efficacy"] for r in one["drug_review_4aspect"]] == [3, 2]
    assert [tuple(r)[5:] for r in one["mental_health_3group"]] == [(1, 1, 0), (0, 1, 1)] and [r["label"] for r in one["mental_health_nominal"]] == ["NORMAL", "SUICIDAL"]
    assert [r["score"] for r in one["mental_health_7L"]] == [1, 7] and [r["score"] for r in one["mental_health_3L"]] == [1, 3]
    path.write_text(raw.replace(",2, Normal", ",9, Normal"))
    with pytest.raises(Exception, match="severity: unknown value"):
        P.read_example(spark, "hate_speech", str(path))
    with pytest.raises(S.SpecError):
        P.read_example(spark, "other", str(path))
    native = spark.createDataFrame([("1", "m", "p", "t", "s", 2, 1)], "item string, evaluator string, prompt string, temp string, seed string, score int, schema_version int")
    native.write.parquet(str(tmp_path / "n"))
    assert P.read_example(spark, "hate_speech", str(tmp_path / "n"), True).count() == 1
    native.withColumn("schema_version", F.lit(2)).write.parquet(str(tmp_path / "n2"))
    with pytest.raises(S.SpecError, match="schema version"):
        P.read_example(spark, "hate_speech", str(tmp_path / "n2"), True)


def test_fixed_facets_and_selection(spark):
    d = S.design("item", ["rater", "occasion"]).resolve("gaussian")
    grid = reliability.allocation_grid(spark, {"rater": [2, 4], "occasion": [2]})
    assert reliability.source_weights(grid, d, ("occasion",), {"occasion": 2}).count() == 2 * 7
    for fixed, observed in ((("occasion",), None), (("rater",), {"rater": 4}), (("rater", "occasion"), {"rater": 4, "occasion": 2}), (("other",), {})):
        with pytest.raises(S.SpecError):
            reliability.source_weights(grid, d, fixed, observed)
    c = spark.createDataFrame([("item", "y", "y", 2.0), ("rater", "y", "y", -0.5), ("Residual", "y", "y", 1.0)], "source string, row string, col string, component double")
    t = reliability.coefficients(reliability.source_weights(grid, d), c)
    assert all(r["Phi"] <= r["Erho2"] for r in t.collect())
    assert reliability.select_results(t, "y", single=True).count() == 2
    with pytest.raises(S.SpecError):
        reliability.select_results(t, "z")


def test_missing_cells_walk(spark):
    rng = np.random.default_rng(9)
    cells = [c for c in itertools.product(range(6), "abcd", range(5)) if rng.random() < 0.8 and c[0] != 3 or c == (3, "a", 0)]
    p = spark.createDataFrame(cells, "i int, r string, o int")
    axes = [sorted({c[k] for c in cells}) for k in range(3)]
    want = [c for c in itertools.product(*axes) if c not in set(cells)]
    for n in (1, 7, 200):
        assert [tuple(r) for r in audit.missing_cells(p, ["i", "r", "o"], n).orderBy("i", "r", "o").collect()] == want[:n]
    status = {r["status"]: r["cell_count_exact"] for r in audit.cell_status(p, ["i", "r", "o"]).collect()}
    assert status == {"complete": str(len(cells)), "under_replicated": "0", "over_replicated": "0", "missing": str(len(want))}


def test_preflight_checks(spark, panel):
    good = preflight.gaussian_checks(panel, S.design("item", ["rater"]), ["y"])
    assert preflight.feasible(good) and preflight.supported_scale(good, TWO, "gaussian") == "observed"
    bad = preflight.gaussian_checks(panel.where("item <> 3 OR rater <> 1"), S.design("item", ["rater"]), ["y"])
    assert not preflight.feasible(bad) and "complete_coded_panel" in preflight.reasons(bad)
    with pytest.raises(S.SpecError, match="complete_coded_panel"):
        preflight.require(bad)
    assert preflight.feasible(preflight.observed_checks(panel.where("item <> 3 OR rater <> 1"), S.design("item", ["rater"])))
    labels = panel.withColumn("label", F.when(F.col("y") > 0, "yes").otherwise("no"))
    d, family = S.design("item", ["rater"], full_cell=False), S.Family("binary", "logit", ("no", "yes"))
    checks = preflight.discrete_checks(labels, d, ["label"], [family])
    assert preflight.feasible(checks) and preflight.supported_scale(checks, d, "binary") == "latent" and preflight.as_table(spark, checks).count() == len(checks)
    fails = lambda *a, **k: {n for n, p, _ in preflight.discrete_checks(*a, **k) if p is False}
    assert "outcome_category_coverage" in fails(labels, d, ["label"], [S.Family("ordinal", "logit", ("no", "maybe", "yes"))])
    assert "random_dimension_limit" in fails(labels, d, ["label"], [family], S.Control(max_random_dim=5))
    assert "parameter_limit" in fails(labels, d, ["label"], [family], S.Control(max_parameters=1))
    assert {"repeated_observations_within_source", "family_design_resolution"} <= fails(labels, S.design("item", ["rater"]), ["label"], [family]) | {"repeated_observations_within_source"}
    assert {r["source_a"] for r in preflight.source_pairs(labels, d).collect()} == {"item", "rater"}
    assert preflight.largest_sources(audit.sources_table(labels, d), 1).first()["source"] == "item"
    assert preflight.total_effects(audit.sources_table(labels, d)) == 28 and audit.kernel_rank(labels, d) == (2, 2)


def test_bootstrap_records_and_intervals(spark, panel):
    f = fit.fit_gaussian(panel, ["y"], TWO)
    records = studies.bootstrap(panel, TWO, ["y"], {"rater": 4}, 60, 3, 64).cache()
    assert records.count() == 64 and records.where("kept").count() == 60
    one = records.where("attempt = 5").first()
    from panelgauge.operators import resampling

    rows = resampling.resample(panel, resampling.draws(panel.select("item", "rater", "y"), "item", 64, 3), "item").where("attempt = 5").toPandas()
    want = fit.fit_prepared(studies.strata_of(studies.complete_array(rows, ["item", "rater"], ["y"]), ["item", "rater"], ["y"]), TWO)
    assert one["component_item_y"] == pytest.approx(want.components["item"][0, 0], rel=1e-6)
    left = studies.jackknife(panel, TWO, ["y"], {"rater": 4}, 50)
    assert left.count() == 24
    estimates = {"component_item_y": float(f.components["item"][0, 0]), "Erho2": fit.coefficient(f, {"rater": 4})[0]}
    plain, bca = (studies.intervals(records, estimates, x) for x in (None, left))
    for t, method in ((plain, "percentile"), (bca, "bca")):
        r = {x["component"]: x for x in t.collect()}["Erho2"]
        assert r["method"] == method and r["lower"] < r["estimate"] < r["upper"]
    c = studies.replicate_coefficients(records, TWO, [{"rater": 4}, {"rater": 8}], "y")
    both = c.where("design_id = 1").join(records.select("attempt", F.col("Erho2").alias("want")), "attempt")
    assert both.count() == 60 and both.agg(F.max(F.abs(F.col("Erho2") - F.col("want")))).first()[0] < 1e-9
    assert {r["status"]: r["attempts"] for r in studies.record_summary(records).collect()}["accepted"] >= 60
    with pytest.raises(S.SpecError, match="one layout"):
        studies.bootstrap(panel.where("item <> 3 OR rater <> 1"), TWO, ["y"], {"rater": 4}, 60)


def test_refit_errors_are_records(spark):
    rows = [(i, r, 1.0 if k == 1 else float(i + r * i), k) for k in (1, 2, 3) for i in range(4) for r in range(3) if k < 3 or (i, r) != (0, 0)]
    got = {r["attempt"]: r["status"] for r in studies.refits(spark.createDataFrame(rows, "item int, rater int, y double, attempt long"), ["attempt"], TWO, ["y"], {"rater": 3}).collect()}
    assert got[1] == got[3] == "fit_error" and got[2] in ("accepted", "numerically_refused")


def test_pilot_and_its_target(spark):
    grid = [{"rater": 3}, {"rater": 6}]
    records = studies.pilot(spark, TWO, grid, 40, AT, 15, 2).cache()
    for r in records.collect():
        assert r["interval_available"] == (r["width"] is not None) and (r["width"] is None or 0 < r["lower"] < r["Erho2"] < r["upper"] < 1)
    ref = studies.reference_coefficients(spark, TWO, grid, AT)
    assert [r["reference"] for r in ref.orderBy("design_id").collect()] == pytest.approx([1.5 / (1.5 + 0.8 / 3), 1.5 / (1.5 + 0.8 / 6)])
    for r in studies.pilot_target_summary(records, ref).collect():
        assert r["attempted"] == 15 and abs(r["bias"]) < 5 * r["bias_mcse"] + 0.02 and r["coverage"] > 0.6


def test_joint_simulation_has_the_covariances(spark, panel):
    f = fit.fit_gaussian(panel, ["y", "z"], TWO)
    big = studies.simulated_from(f, spark, 3000, {"rater": 12}, 5, {"y": 2.0})
    again = fit.fit_gaussian(big, ["y", "z"], TWO)
    for s in ("item", "Residual"):
        assert again.components[s] == pytest.approx(f.components[s], rel=0.15, abs=0.1)
    with pytest.raises(S.SpecError):
        studies.simulated_from(f, spark, 3000, {"rater": 12}, max_rows=100)


def test_vector_ratio_against_numpy(spark):
    rng = np.random.default_rng(8)
    rows = [(i, k, *p) for k in (1, 2) for i in range(30) for p in rng.dirichlet([1 + i % 3, 2, 1], 4)]
    df = spark.createDataFrame([(int(i), int(k), *map(float, p)) for i, k, *p in rows], "item int, panel int, p0 double, p1 double, p2 double")
    half = [votes.item_moments(df.where(F.col("panel") == k), "item", ["p0", "p1", "p2"]) for k in (1, 2)]
    got = votes.vector_ratio(*half, "item", ["p0", "p1", "p2"]).first()
    t = pd.DataFrame(rows, columns=["i", "k", "a", "b", "c"])
    m = [t[t.k == k].groupby("i")[["a", "b", "c"]].mean().to_numpy() for k in (1, 2)]
    second = [(x**2).sum(1) + np.array([sum(1 - (g[["a", "b", "c"]].to_numpy() ** 2).sum(1)) / len(g) ** 2 for _, g in t[t.k == k].groupby("i")]) for k, x in zip((1, 2), m, strict=True)]
    signal = (m[0] * m[1]).sum(1).mean() - (m[0].mean(0) * m[1].mean(0)).sum()
    total = np.mean(second) - (((m[0].mean(0) + m[1].mean(0)) / 2) ** 2).sum()
    assert (got["signal_variance"], got["total_variance"], got["raw_estimate"]) == pytest.approx((signal, total, signal / total)) and got["mc_se"] > 0


def test_targets_and_scores(spark):
    assert studies.check_scores(None, ["a", "b"], "ordinal") == [1.0, 2.0]
    for scores, family in (({"a": 1.0}, "ordinal"), ({"a": 2.0, "b": 1.0}, "ordinal"), (None, "categorical"), ({"a": 1.0, "b": 1.0}, "categorical")):
        with pytest.raises(S.SpecError):
            studies.check_scores(scores, ["a", "b"], family)
    d = S.design("item", ["rater"], full_cell=False)
    args = (spark, d, {"rater": 4}, {"item": 1.5, "rater": 0.2}, [-0.7, 0.6], ["low", "mid", "high"])
    for target in ("decision_agreement", "observed_score", "category_vector"):
        r = studies.categorical_target(*args, target, None, 60, 6, 3).first()
        assert r["available"] and 0 < r["estimate"] <= 1
    with pytest.raises(S.SpecError):
        studies.categorical_target(*args, "other")
    with pytest.raises(S.SpecError):
        studies.categorical_target(*args, max_rows=10)
    plan = studies.categorical_plan(spark, d, [{"rater": 2}, {"rater": 8}], *args[3:], {"annotation": 1.0 * F.col("allocation_rater")}, 0.2, "observed_score", 60, 4, 3).orderBy("design_id").collect()
    assert plan[1]["estimate"] > plan[0]["estimate"] and plan[0]["total_cost"] < plan[1]["total_cost"] and all(r["pareto"] for r in plan)


def test_batch_kernels_floor_negative_components(spark):
    c = spark.createDataFrame([("item", "y", "y", 1.0), ("rater", "y", "y", -1.0), ("Call", "y", "y", 0.2), ("Residual", "y", "y", 0.5)], "source string, row string, col string, component double")
    targets = spark.createDataFrame([("t", "absolute_item", 1, 1.0)], "target string, target_kind string, item long, weight double")
    layout = spark.createDataFrame([(1, 1), (2, 1)], "item long, batch int")
    k = spark.createDataFrame([(1, *x) for x in batches.kernels(TWO, {"rater": 2})], "design_id long, source string, kernel string, divisor double, role string")
    r = batches.batch_summary(batches.batch_contributions(batches.contractions(targets, layout), k, c)).first()
    assert r["coefficient"] == pytest.approx(1 / (1 + 0.1 + 0.25))


def test_observed_rows_equal_the_exact_engine_on_a_complete_panel(panel):
    rows = panel.select("item", "rater", "y").collect()
    f = fit.fit_gaussian(panel, ["y"], TWO)
    cells, values = [(r["item"], r["rater"]) for r in rows], [100 * r["y"] + 7 for r in rows]
    o = fit.fit_observed_rows(cells, values, TWO)
    assert o.accepted and o.mean == pytest.approx(np.mean(values))
    for s, m in f.components.items():
        assert o.components[s] == pytest.approx(1e4 * m[0, 0], rel=1e-3, abs=2.0)
    assert o.deviance == pytest.approx(f.deviance + 2 * 95 * np.log(100), abs=1e-3)
    assert o.coefficient({"rater": 4}, projection="balanced") == pytest.approx(fit.coefficient(f, {"rater": 4})[0], abs=1e-3)
    part = fit.fit_observed_rows(cells[:-9], values[:-9], TWO)
    assert part.accepted and part.rows == 87
    with pytest.raises(S.SpecError, match="balanced"):
        part.coefficient({"rater": 4})
    for bad in ((cells[:4], [1.0] * 4), (cells[:5] + cells[:1], values[:6]), ([c for c in cells if c[1] == cells[0][1]], [v for c, v in zip(cells, values, strict=True) if c[1] == cells[0][1]])):
        with pytest.raises(S.SpecError):
            fit.fit_observed_rows(*bad, TWO)


def test_stored_order_audit(spark):
    rows = [(i, r, k) for r in range(3) for k, i in enumerate([3, 1, 2, 0, 5, 4, 6, 7] if r else [0, 1, 2, 3, 4, 5, 6, 7])]
    got = batches.stored_order_audit(spark.createDataFrame(rows, "item int, rater int, at int"), "item", ["rater"], "at", 4).first()
    assert tuple(got) == (3, 2, 2, 2, 0)
    got = batches.stored_order_audit(spark.createDataFrame([*rows[:-1], (0, 2, 7)], "item int, rater int, at int"), "item", ["rater"], "at", 4).first()
    assert tuple(got) == (3, 2, 2, 1, 0)


def test_charts_and_report(spark, panel, tmp_path):
    from panelgauge.operators import charts, report

    f = fit.fit_gaussian(panel, ["y", "z"], TWO)
    r = report.snapshot(f, [{"rater": 4}], checks=[("outcome_category_coverage", False, "y: absent: secret")], bootstrap=[{"component": "Erho2", "lower": 0.5}])
    assert r["coefficients"][0]["Erho2_lower"] < r["coefficients"][0]["Erho2"] < r["coefficients"][0]["Erho2_upper"] and "secret" not in str(r)
    page = open(report.export_html(r, str(tmp_path / "r.html"))).read()
    assert page.count("<svg") == 1 and "Preflight" in page and "Bootstrap" in page
    assert charts.lines([{"rater": n, "Erho2": n / 10, "o": n % 2} for n in range(1, 6)], "rater", by="o").count("<polyline") == 2
    assert charts.heat_map([{"variable": "item", "category": "<a>", "coverage": 0.5}], "variable", "category").count("&lt;a&gt;") == 1
    assert "not available" in charts.bars([{"o": "y", "Erho2": None}], "o")
    with pytest.raises(S.SpecError):
        charts.bars([{"o": "y", "Erho2": 0.5}] * 3000, "o")


def test_context_ledger_and_specimens(spark, panel, tmp_path):
    from panelgauge.operators import laplace

    f = fit.fit_gaussian(panel, ["y"], TWO)
    assert methods.context(f) == "observed"
    with pytest.raises(S.SpecError, match="observed scale"):
        methods.context(f, "latent")
    family = S.Family("binary", "logit", ("no", "yes"))
    code = (np.arange(60)[:, None] * 7 % 3 > 0).astype(int)
    p = laplace.Problem(code, np.ones(60), {"item": np.arange(60) // 5, "rater": np.arange(60) % 5}, laplace.blocks_of({"y": (family, family.levels)}), None, S.Control(specimen_dir=str(tmp_path / "s")))
    assert p.value(np.array([np.nan, 1.0, 1.0])) == np.inf and len(list((tmp_path / "s").iterdir())) == 1
    g = laplace.fit_problem(p, S.design("item", ["rater"], full_cell=False), restart=False, information=False)
    assert {r["kind"] for r in methods.ledger(spark, g).collect()} >= {"evaluations"}
    for bad in ({"max_axes": 0}, {"tolerance": 2.0}, {"retain": frozenset({"rows"})}):
        with pytest.raises(S.SpecError):
            S.Control(**bad)


def test_large_grids_stop(spark):
    t = spark.range(10_001).select(F.col("id").alias("design_id"), F.lit(0.5).alias("Erho2"), F.col("id").cast("double").alias("measurements_per_object"), F.lit(True).alias("measurement_count_exact"))
    assert reliability.dstudy_target(t.limit(10_000), 0.4).where("fewest_measurements").count() == 1
    with pytest.raises(Exception, match="at most 10000 rows"):
        reliability.dstudy_target(t, 0.4).collect()


def test_empty_panels_have_no_strata(panel):
    from panelgauge.operators import strata

    none = panel.where("item < 0")
    assert strata.strata(none, ["y"], ["item", "rater"]).count() == 0 and strata.moment_components(none, ["y"], ["item", "rater"]).count() == 0
    assert audit.missing_cells(none, ["item", "rater"]).count() == 0
