import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgauge import spec as S
from panelgauge.functions import numeric as N
from panelgauge.operators import audit, discrete, fit, planning, reliability, report, resampling, simulate, strata, votes

GOLDEN = {"item": 2.0, "rater": 0.4, "occasion": 0.2, "item:rater": 1.2, "item:occasion": 0.1, "rater:occasion": 0.3, "Residual": 0.6}


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    i, r, o = rng.normal(0, 1.2, 12), rng.normal(0, 0.6, 4), rng.normal(0, 0.5, 3)
    ir = rng.normal(0, 0.8, (12, 4))
    rows = [(f"i{a}", f"r{b}", c, float(i[a] + r[b] + o[c] + ir[a, b] + rng.normal(0, 0.7)), float(0.5 * i[a] + rng.normal())) for a, b, c in itertools.product(range(12), range(4), range(3))]
    return spark.createDataFrame(rows, "item string, rater string, occasion int, y double, z double").cache()


AXES = ["item", "rater", "occasion"]
DESIGN = S.design("item", ["rater", "occasion"]).resolve("gaussian")


def dense_deviance(rows, components, reml):
    n = len(rows)
    y = np.array([r["y"] for r in rows])
    v = components["Residual"] * np.eye(n)
    for s, x in components.items():
        if s != "Residual":
            key = [tuple(r[m] for m in s.split(":")) for r in rows]
            v += x * np.array([[a == b for b in key] for a in key])
    inv, one = np.linalg.inv(v), np.ones(n)
    mu = (one @ inv @ y) / (one @ inv @ one)
    return (n - reml) * np.log(2 * np.pi) + np.linalg.slogdet(v)[1] + (np.log(one @ inv @ one) if reml else 0) + (y - mu) @ inv @ (y - mu)


@pytest.mark.parametrize("reml", [True, False])
def test_deviance_from_strata_equals_dense(panel, reml):
    rows = panel.collect()
    p = fit.prepare(panel, ["y"], AXES)
    comps = {k: np.array([[v]]) for k, v in GOLDEN.items()}
    want = dense_deviance(rows, GOLDEN, reml)
    assert fit.deviance(p, comps, fit.source_masks(DESIGN, AXES), reml) == pytest.approx(want, rel=1e-9)
    got = strata.deviance(strata.strata(panel, ["y"], AXES), GOLDEN, AXES, reml).first()[0]
    assert got == pytest.approx(want, rel=1e-9)


def test_deviance_slopes(panel):
    p, masks = fit.prepare(panel, ["y", "z"], AXES), fit.source_masks(DESIGN, AXES)
    rng = np.random.default_rng(1)
    comps = {s: (lambda a: a @ a.T + 0.1 * np.eye(2))(rng.normal(size=(2, 2))) for s in [*masks, "Residual"]}
    _, slopes = fit.deviance(p, comps, masks, True, True)
    for s in comps:
        for i, j in ((0, 0), (0, 1)):
            e = np.zeros((2, 2))
            e[i, j] = e[j, i] = 1e-5
            up, dn = (fit.deviance(p, comps | {s: comps[s] + k * e}, masks, True) for k in (1, -1))
            assert (up - dn) / 2e-5 == pytest.approx(slopes[s][i, j] * (1 if i == j else 2), rel=1e-4, abs=1e-5)


def test_reml_equals_moments_when_all_are_positive(spark):
    big = simulate.gaussian_panel(spark, DESIGN, {"item": 40, "rater": 12, "occasion": 10}, {k: v + 1 for k, v in GOLDEN.items()}, seed=6)
    mom = {r["source"]: r["component"] for r in strata.moment_components(big, ["y"], AXES).collect()}
    assert min(mom.values()) > 0
    f = fit.fit_gaussian(big, formula="y ~ item * rater * occasion")
    assert f.accepted
    for s, v in mom.items():
        assert float(f.components[s][0, 0]) == pytest.approx(v, rel=1e-2)


def test_scaling_leaves_g_unchanged(panel):
    a = fit.fit_gaussian(panel, ["y"], DESIGN)
    b = fit.fit_gaussian(panel.withColumn("y", F.col("y") * 3 + 7), ["y"], DESIGN)
    counts = {"rater": 4, "occasion": 3}
    assert fit.coefficient(a, counts)[0] == pytest.approx(fit.coefficient(b, counts)[0], abs=1e-4)


def test_observed_rows_match_exact_on_a_complete_panel(panel):
    design = S.design("item", ["rater"]).resolve("gaussian")
    flat = panel.groupBy("item", "rater").agg(F.avg("y").alias("y"))
    exact = fit.fit_gaussian(flat, ["y"], design)
    rows = flat.collect()
    at, dev = fit.fit_observed([(r["item"], r["rater"]) for r in rows], [r["y"] for r in rows], design)
    assert dev == pytest.approx(exact.deviance, abs=1e-3)
    assert at["item"] == pytest.approx(float(exact.components["item"][0, 0]), rel=2e-2)


def test_golden_coefficients(spark):
    g = reliability.allocation_grid(spark, {"rater": [1, 2, 3, 4], "occasion": [1, 2, 3]})
    c = spark.createDataFrame([(s, "y", "y", v) for s, v in GOLDEN.items()], "source string, row string, col string, component double")
    for r in reliability.coefficients(reliability.source_weights(g, DESIGN), c).collect():
        n, o = r["rater"], r["occasion"]
        e = 1.2 / n + 0.1 / o + 0.6 / (n * o)
        assert r["relative_error"] == pytest.approx(e) and r["Erho2"] == pytest.approx(2 / (2 + e))
        assert r["absolute_error"] == pytest.approx(e + 0.4 / n + 0.2 / o + 0.3 / (n * o))


def test_fixed_facets_refused_when_all_are_fixed(spark):
    g = reliability.allocation_grid(spark, {"rater": [2], "occasion": [2]})
    with pytest.raises(S.SpecError):
        reliability.source_weights(g, DESIGN, ("rater", "occasion"))


def test_plan_ties(spark):
    t = spark.createDataFrame([(1, 5.0, 0.8, True), (2, 5.0, 0.8, True), (3, 4.0, 0.9, False), (4, 8.0, 0.9, True)], "design_id long, total_cost double, v double, feasible boolean")
    out = {r["design_id"]: (r["minimum_cost"], r["pareto"]) for r in planning.pareto(planning.screen(t, 0.7, F.col("v"))).collect()}
    assert out == {1: (True, True), 2: (True, True), 3: (False, False), 4: (False, True)}


def test_pareto_evaluates_its_rows_once(spark):
    """Another last place at every evaluation, as in sums of doubles over shuffles, and still the front of the rows as they are."""
    grid = [(i, float(i * 7 % 5), None if i % 11 == 3 else float(i * 5 % 7) / 8, None if i % 13 == 5 else i % 6 != 1) for i in range(40)]
    t = spark.createDataFrame(grid, "design_id long, total_cost double, v double, feasible boolean")
    noise = F.udf(lambda v: None if v is None else v + random.random() * 1e-12, "double").asNondeterministic()
    for value in (F.col("v"), noise("v")):
        found = planning.pareto(planning.screen(t, 0.7, value)).collect()
        usable = [(r["total_cost"], r["screening_value"]) for r in found if r["feasible"] and r["screening_value"] is not None]
        better = lambda c, v: any(x <= c and y >= v and (x, y) != (c, v) for x, y in usable)
        for r in found:
            want = False if r["feasible"] is False else None if r["feasible"] is None or r["screening_value"] is None else not better(r["total_cost"], r["screening_value"])
            assert r["pareto"] is want, r
        assert any(r["pareto"] for r in found)


def test_tuple_keys_do_not_collide(spark):
    rows = [(a, b, c, float(i)) for i, (a, b, c) in enumerate(itertools.product(["a:b", "a", "other"], ["c", "b:c"], ["first", "second"]))]
    p = spark.createDataFrame(rows, "sep string, collapse string, recycle0 string, y double")
    assert audit.completeness(p, ["sep", "collapse", "recycle0"]).first()["balanced"]


@pytest.mark.parametrize("change", ["drop", "repeat", "constant", "null"])
def test_exact_engine_refuses(panel, change):
    p = {"drop": lambda: panel.where("NOT (item = 'i1' AND rater = 'r1' AND occasion = 1)"), "repeat": lambda: panel.unionByName(panel.limit(1)), "constant": lambda: panel.withColumn("y", F.lit(1.0)), "null": lambda: panel.withColumn("y", F.when(F.col("rater") != "r1", F.col("y")))}[change]()
    with pytest.raises(S.SpecError):
        fit.fit_gaussian(p, ["y"], DESIGN)


def test_votes_share_ties(spark):
    p = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (2, "b")], "item long, label string")
    assert {(r["item"], r["label"], r["share"]) for r in votes.plurality_votes(p, "item", "label").collect()} == {(1, "a", 0.5), (1, "b", 0.5), (2, "a", 1.0)}
    assert votes.decision_agreement(p, p, "item", "label").first()["agreement"] == pytest.approx(0.75)


def test_quantile_type_6(spark):
    v = [float(x) for x in (3, 1, 4, 1, 5, 9, 2, 6)]
    got = spark.createDataFrame([(sorted(v),)], "v array<double>").select(N.quantile6(F.col("v"), 0.3).alias("q")).first()["q"]
    s = sorted(v)
    h = 9 * 0.3
    assert got == pytest.approx(s[1] + (h - 2) * (s[2] - s[1]))


def test_resample_keeps_rows_and_repeats(panel):
    d = resampling.draws(panel, "item", 3, 5)
    rows = resampling.resample(panel, d, "item").groupBy("attempt").count().collect()
    assert [r["count"] for r in rows] == [144] * 3
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, resampling.draws(panel.orderBy(F.rand()), "item", 3, 5).collect()))


def test_simulation_is_stable_and_has_the_variances(spark):
    p = simulate.gaussian_panel(spark, S.design("item", ["rater"]).resolve("gaussian"), {"item": 400, "rater": 50}, {"item": 2.0, "rater": 0.5, "Residual": 1.0}, seed=8)
    assert p.agg(F.sum("y")).first()[0] == pytest.approx(p.repartition(7).agg(F.sum("y")).first()[0])
    m = {r["source"]: r["component"] for r in strata.moment_components(p, ["y"], ["item", "rater"]).collect()}
    assert m["item"] == pytest.approx(2.0, rel=0.2) and m["Residual"] == pytest.approx(1.0, rel=0.05)


def test_laplace_against_quadrature():
    """One source, binary logit: the Laplace value is near the exact marginal likelihood by Gauss-Hermite."""
    rng = np.random.default_rng(2)
    rows = [{"item": i, "rater": j, "label": "yes" if rng.random() < 1 / (1 + np.exp(-b)) else "no", "n": 1} for i, b in enumerate(rng.normal(0, 1, 40)) for j in range(20)]
    d = S.design("item", ["rater"], random=["item"])
    f = discrete.fit_laplace(rows, d, "label", S.Family("binary", "logit", ("no", "yes")), ("no", "yes"))
    x, w = np.polynomial.hermite_e.hermegauss(60)

    def nll(sd, t):
        out = 0.0
        for i in range(40):
            k = sum(r["label"] == "yes" for r in rows if r["item"] == i)
            p = 1 / (1 + np.exp(-(x * sd - t)))
            out -= np.log((w * p**k * (1 - p) ** (20 - k)).sum() / np.sqrt(2 * np.pi))
        return out

    sd, t = np.sqrt(f.variances["item"]), float(f.thresholds[0])
    assert f.nll == pytest.approx(nll(sd, t), abs=1.0)
    assert nll(sd, t) < min(nll(s, t) for s in (sd * 0.7, sd * 1.4)) + 0.05


def test_report(panel, tmp_path):
    f = fit.fit_gaussian(panel, ["y"], DESIGN)
    r = report.snapshot(f, [{"rater": 4, "occasion": 3}])
    path = str(tmp_path / "r.html")
    assert "<svg" in open(report.export_html(r, path)).read()
    with pytest.raises(S.SpecError):
        report.export_html(r, path)
    with pytest.raises(S.SpecError):
        report.snapshot(f, [{"rater": 4, "occasion": 3}], {("y", 4, 3): 0.123})


def test_streaming_counts(spark, panel, tmp_path):
    from panelgauge.streaming import completeness

    panel.write.parquet(str(tmp_path / "in"))
    s = completeness.running_cells(spark.readStream.schema(panel.schema).parquet(str(tmp_path / "in")), ["rater"])
    q = s.writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    assert {r["rows"] for r in spark.table("cells").collect()} == {36}
