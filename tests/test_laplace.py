"""The Laplace engine: kernels and slopes against differences, values against dense algebra and quadrature, fits, checks, refusals."""

import numpy as np
import pytest

from panelgauge import spec as S
from panelgauge.operators import discrete, laplace, methods, response

BINARY, PROBIT = S.Family("binary", "logit", ("no", "yes")), S.Family("ordinal", "probit", ("a", "b", "c"))
ORDINAL, NOMINAL = S.Family("ordinal", "logit", ("a", "b", "c", "d")), S.Family("categorical", None, ("a", "b", "c"))


@pytest.mark.parametrize("link", ["logit", "probit"])
def test_cut_kernel_slopes(link):
    rng = np.random.default_rng(1)
    family, cuts, h = S.Family("ordinal", link, ("a", "b", "c", "d")), np.array([-1.0, 0.2, 0.5]), 1e-5
    eta, code = rng.normal(size=300) * 2, rng.integers(0, 4, 300)
    k, up, down = (response.cut_kernel(family, eta + x, code, cuts) for x in (0, h, -h))
    for f, slope in (("loss", k.g), ("g", k.w), ("w", k.t)):
        assert np.abs((getattr(up, f) - getattr(down, f)) / (2 * h) - slope).max() < 1e-6
    for j in range(3):
        a, b = (response.cut_kernel(family, eta, code, cuts + x * np.eye(3)[j]) for x in (h, -h))
        for f in ("loss", "g", "w"):
            want = np.where(code == j + 1, getattr(k, f"{f}_a"), 0) + np.where(code == j, getattr(k, f"{f}_b"), 0)
            assert np.abs((getattr(a, f) - getattr(b, f)) / (2 * h) - want).max() < 1e-6


def test_far_tails_and_narrow_cuts_stay_finite():
    for link in ("logit", "probit"):
        family = S.Family("ordinal", link, ("a", "b", "c"))
        eta = np.array([-300.0, -40.0, -9.0, 0.0, 9.0, 40.0, 300.0])
        for width in (1e-7, 0.3, 5.0):
            for code in range(3):
                k = response.cut_kernel(family, eta, np.full(len(eta), code), np.array([0.0, width]))
                assert np.isfinite(k.loss).all() and np.isfinite(k.g).all() and np.isfinite(k.w).all() and (k.w >= 0).all()
    assert response.log_normal_cdf(np.array([-40.0, -35.0, -34.9999])) == pytest.approx([-804.608442, -616.975101, -616.971598], rel=1e-6)


def test_choice_third_derivatives():
    rng = np.random.default_rng(2)
    e, c, b, h = rng.normal(size=(40, 3)), rng.integers(0, 4, 40), rng.normal(size=(40, 3, 3)), 1e-5
    b = b + b.transpose(0, 2, 1)
    want = np.stack([0.5 * np.einsum("rab,rab->r", b, (response.choice_kernel(e + h * x, c).w - response.choice_kernel(e - h * x, c).w) / (2 * h)) for x in np.eye(3)], 1)
    assert np.abs(response.choice_kernel(e, c).third(b) - want).max() < 1e-8


def made(items, raters, repeats, families, seed=1, sd=(1.0, 0.6, 0.4)):
    rng = np.random.default_rng(seed)
    i, r, _ = [a.ravel() for a in np.meshgrid(np.arange(items), np.arange(raters), np.arange(repeats), indexing="ij")]
    groups = {"item": i, "rater": r, "item:rater": i * raters + r}
    codes = []
    for f in families.values():
        draw = lambda: sum(s * rng.normal(size=g.max() + 1)[g] for s, g in zip(sd, groups.values(), strict=True))
        if f.family == "categorical":
            z = np.stack([np.zeros(len(i)), *[draw() for _ in f.levels[1:]]], 1)
            codes.append((z + rng.gumbel(size=z.shape)).argmax(1))
        else:
            y = draw() + (rng.logistic(size=len(i)) if f.link == "logit" else rng.normal(size=len(i)))
            codes.append((y[:, None] > (np.linspace(-1, 1, len(f.levels) - 1) if len(f.levels) > 2 else np.zeros(1))).sum(1))
    return np.stack(codes, 1), rng.integers(1, 3, len(i)).astype(float), groups, laplace.blocks_of({n: (f, f.levels) for n, f in families.items()})


CASES = [
    ({"y": BINARY}, None),
    ({"y": PROBIT}, None),
    ({"y": ORDINAL, "z": BINARY}, {"rater": "diagonal"}),
    ({"y": NOMINAL}, {"item": "unstructured", "rater": "diagonal", "item:rater": "exchangeable"}),
    ({"y": NOMINAL, "z": PROBIT}, {"item": "unstructured", "rater": "exchangeable", "item:rater": "diagonal"}),
]


@pytest.mark.parametrize("families,covariance", CASES)
def test_slope_and_value(families, covariance):
    p = laplace.Problem(*made(10, 4, 3, families), covariance)
    x = p.start() + 0.1 * np.random.default_rng(3).normal(size=p.parameters)
    value, slope = p.gradient(x)
    want = [(p.value(x + 1e-5 * e) - p.value(x - 1e-5 * e)) / 2e-5 for e in np.eye(len(x))]
    assert np.abs(slope - want).max() < 1e-4
    # one dense matrix from rows and effects, without pairs or elimination
    fixed, factors = p.unpack(x)
    u, kernels, w, h = p.find_mode(fixed, factors)
    a = np.zeros((len(p.n), p.d, p.total))
    for s in p.names:
        for k in range(p.d):
            a[np.arange(len(p.n))[:, None], np.arange(p.d)[None, :], (p.offset[s] + p.groups[s] * p.d + k)[:, None]] += factors[s][:, k]
    dense = np.eye(p.total) + np.einsum("r,rik,rij,rjl->kl", p.n, a, w, a, optimize=True)
    assert value == pytest.approx(p.loss(u, fixed, factors) + 0.5 * np.linalg.slogdet(dense)[1], abs=1e-7)
    assert np.abs(p.hessian(x)[0] - dense).max() < 1e-9
    v = np.sin(np.arange(p.total))
    assert np.abs(dense @ h.solve(v) - v).max() < 1e-8
    inverse, selected = np.linalg.inv(dense), p.selected(h)
    for (s, t), (g, k, _) in p.pairs.items():
        rows, cols = (p.offset[s] + g * p.d)[:, None, None] + np.arange(p.d)[None, :, None], (p.offset[t] + k * p.d)[:, None, None] + np.arange(p.d)[None, None, :]
        assert np.abs(selected(s, t) - inverse[rows, cols]).max() < 1e-9


def test_fit_recovers_and_records():
    families = {"y": BINARY, "z": ORDINAL}
    p = laplace.Problem(*made(80, 8, 3, families, sd=(1.2, 0.6, 0.0)), {"item:rater": "diagonal"})
    d = S.design("item", ["rater"], replicates=3)
    f = laplace.fit_problem(p, d)
    assert f.accepted and f.gradient < 1e-5 and {s for _, s, _ in f.stages} == {"passed"}
    assert np.diag(f.components["item"]) == pytest.approx([1.44, 1.44], rel=0.5)
    errors = np.sqrt(np.diag(f.entry_covariance))
    assert len(errors) == len(f.entry_names) and (errors > 0).any() and errors.max() < 2
    g = discrete.latent_coefficient(f, {"rater": 8}, latent=1)
    assert 0.4 < g < 1 and 0 < discrete.coefficient_error(f, {"rater": 8}, latent=1) < 0.2
    assert methods.log_likelihood(f) == (-f.nll, p.parameters) and methods.nobs(f) == int(p.n.sum())
    assert list(methods.coef(f)) == ["y|1", "z|1", "z|2", "z|3"] and "accepted" in methods.describe(f)


def test_nominal_eigenvalues_and_error():
    p = laplace.Problem(*made(60, 6, 2, {"y": NOMINAL}, sd=(1.3, 0.5, 0.0)), {"item": "unstructured", "rater": "exchangeable", "item:rater": "exchangeable"})
    f = laplace.fit_problem(p, S.design("item", ["rater"], replicates=2), restart=False)
    u, e = discrete.latent_parts(f, {"rater": 6})
    values = discrete.nominal_eigenvalues(u, e)
    assert (values > 0.2).all() and (values < 1).all() and 0 < discrete.nominal_error(f, {"rater": 6}) < 0.2


def test_checks_against_quadrature(spark):
    """Four effects: adaptive quadrature is exact enough to hold Laplace and the importance sampler against."""
    rows = [{"item": i, "rater": r, "label": x, "n": n} for i, r, x, n in [(0, 0, "no", 6), (0, 0, "yes", 2), (0, 1, "yes", 3), (0, 1, "no", 3), (1, 0, "yes", 5), (1, 0, "no", 1), (1, 1, "yes", 7), (1, 1, "no", 2)]]
    d = S.design("item", ["rater"], full_cell=False)
    f = discrete.fit_laplace(rows, d, "label", BINARY, ("no", "yes"), restart=False)
    x = f.x.copy()
    x[f.problem.fixed :] = [0.8, 0.5]  # away from the boundary
    f.x, f.nll = x, f.problem.value(x)
    at, exact = discrete.quadrature_check(f, 15)
    assert exact == pytest.approx(discrete.quadrature_check(f, 21)[1], abs=1e-5) and at == pytest.approx(exact, abs=0.3)
    got = discrete.laplace_check(spark, f, 3000, 2).first()
    assert 0 < got["mc_se"] < 0.2 and abs(got["refined_minus2loglik"] - exact) < 4 * got["mc_se"] and got["usable"]
    assert got["difference"] == pytest.approx(at - got["refined_minus2loglik"])


def test_zero_variance_is_left_or_kept():
    rng = np.random.default_rng(5)
    code = rng.integers(0, 2, (200, 1))
    groups = {"item": np.repeat(np.arange(40), 5), "rater": np.tile(np.arange(5), 40)}
    f = laplace.fit_problem(laplace.Problem(code, np.ones(200), groups, laplace.blocks_of({"y": (BINARY, BINARY.levels)})), S.design("item", ["rater"], full_cell=False))
    assert f.accepted and min(f.variances.values()) < 0.2
    p = laplace.Problem(*made(40, 6, 3, {"y": BINARY}, sd=(1.5, 0.5, 0.5)))
    start = p.start()
    start[p.fixed :] = 0.0  # a stationary point by symmetry
    assert laplace.fit_problem(p, S.design("item", ["rater"], replicates=3), restart=False, start=start).variances["item"] > 0.5


def test_limits_are_refused(spark):
    codes, n, groups, blocks = made(10, 4, 2, {"y": BINARY})
    for c in (S.Control(max_random_dim=20), S.Control(max_dense_dim=3), S.Control(max_parameters=2), S.Control(max_bytes=100)):
        with pytest.raises(S.SpecError):
            laplace.Problem(codes, n, groups, blocks, None, c)
    with pytest.raises(S.SpecError):
        laplace.Problem(codes, n, groups, blocks, {"item": "banded"})
    panel = spark.createDataFrame([(i, r, "no" if (i + r) % 3 else "yes") for i in range(6) for r in range(4)], "item int, rater int, label string")
    d = S.design("item", ["rater"], full_cell=False)
    with pytest.raises(S.SpecError, match="outside"):
        discrete.collapse(panel, d, "label", S.Family("binary", "logit", ("no", "other")))
    with pytest.raises(S.SpecError, match="does not occur"):
        discrete.collapse(panel, d, "label", S.Family("ordinal", "logit", ("no", "yes", "maybe")))
    with pytest.raises(S.SpecError, match="distinct rows"):
        discrete.collapse(panel, d, "label", BINARY, S.Control(max_rows_discrete=5))
