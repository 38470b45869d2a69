"""Discrete outcomes: a panel is collapsed by Spark to counted rows, fitted by the Laplace engine and checked by importance sampling.

Identical rows (same groups, same labels) are collapsed to counts first, which is
exact for the likelihood; what reaches the driver is bounded by the documented controls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import CALL, Control, Design, Family, SpecError
from .laplace import LaplaceFit, Problem, blocks_of, fit_problem

DEFAULT_LEVELS = 1000


def resolve_levels(panel: DataFrame, outcome: str, family: Family) -> tuple:
    """The declared levels, or those seen in ascending order; every row's label must be one of them and each of them must occur."""
    counts = panel.groupBy(outcome).agg(F.count("*").alias("n"))
    if family.levels is None:
        seen = [r[0] for r in counts.select(outcome).limit(DEFAULT_LEVELS + 1).collect()]
        if len(seen) > DEFAULT_LEVELS:
            raise SpecError(f"more than {DEFAULT_LEVELS} labels and none declared")
        levels = tuple(sorted(seen))
    else:
        levels = tuple(family.levels)
        odd = [r[0] for r in counts.where(F.col(outcome).isNull() | ~F.col(outcome).isin(*levels)).limit(5).collect()]
        if odd:
            raise SpecError(f"labels outside the declared levels: {odd}")
        lost = set(levels) - {r[0] for r in counts.select(outcome).collect()}  # at most the declared levels
        if lost:
            raise SpecError(f"a declared level does not occur: {sorted(map(str, lost))}")
    if (family.family == "binary") != (len(levels) == 2):
        raise SpecError("binary needs two levels, ordinal and categorical three or more")
    if family.reference is not None:
        if family.reference not in levels:
            raise SpecError("the reference is no level")
        levels = (family.reference, *[x for x in levels if x != family.reference])
    return levels


def collapse(panel: DataFrame, design: Design, outcome: str | list[str], family: Family | list[Family], control: Control = Control()) -> tuple[tuple, list]:
    """Levels (of each outcome), and one row for each group combination and labels with its count (bounded, collected)."""
    outcomes, families = ([outcome], [family]) if isinstance(outcome, str) else (list(outcome), list(family))
    levels = tuple(resolve_levels(panel, o, f) for o, f in zip(outcomes, families, strict=True))
    rows = panel.groupBy(*design.variables, *outcomes).agg(F.count("*").alias("n")).limit(control.max_rows_discrete + 1).collect()
    if len(rows) > control.max_rows_discrete:
        raise SpecError(f"more than {control.max_rows_discrete} distinct rows for the discrete engine")
    return (levels[0] if isinstance(outcome, str) else levels), rows


def problem_of(rows: list, design: Design, outcomes: list[str], families: list[Family], levels: list[tuple], covariance: dict[str, str] | None = None, control: Control = Control()) -> Problem:
    """Codes, counts and groups of the collapsed rows."""
    number = [{x: k for k, x in enumerate(lv)} for lv in levels]
    codes = np.array([[number[k][r[o]] for k, o in enumerate(outcomes)] for r in rows], np.int64).reshape(-1, len(outcomes))
    groups = {}
    for s, members in design.terms.items():
        known: dict = {}
        groups[s] = np.array([known.setdefault(tuple(r[m] for m in members), len(known)) for r in rows], np.int64)
    unknown = set(covariance or {}) - set(groups)
    if unknown:
        raise SpecError(f"covariance names no source: {sorted(unknown)}")
    return Problem(codes, np.array([r["n"] for r in rows], float), groups, blocks_of({o: (f, lv) for o, f, lv in zip(outcomes, families, levels, strict=True)}), covariance, control)


def fit_laplace(rows: list, design: Design, outcome: str | list[str], family: Family | list[Family], levels: tuple, control: Control = Control(), covariance: dict[str, str] | None = None, restart: bool = True, information: bool = True) -> LaplaceFit:
    """Fit collapsed rows: one outcome, or several that share the sources. ``covariance``: unstructured, diagonal or exchangeable by source."""
    single = isinstance(outcome, str)
    outcomes, families, levels = ([outcome], [family], [levels]) if single else (list(outcome), list(family), list(levels))
    full = ":".join(design.variables)
    design = design.resolve(families[0].family) if full in design.terms else design
    return fit_problem(problem_of(rows, design, outcomes, families, levels, covariance, control), design, restart, information)


def fit_discrete(panel: DataFrame, design: Design, outcome: str | list[str], family: Family | list[Family], control: Control = Control(), covariance: dict[str, str] | None = None) -> LaplaceFit:
    """Collapse and fit a panel."""
    levels, rows = collapse(panel, design, outcome, family, control)
    return fit_laplace(rows, design, outcome, family, levels, control, covariance)


def latent_coefficient(fit: LaplaceFit, counts: dict[str, int], kind: str = "Erho2", latent: int = 0) -> float | None:
    """G or Phi of one latent value, with the link's residual."""
    u, e = latent_parts(fit, counts, kind)
    total = u[latent, latent] + e[latent, latent]
    return float(u[latent, latent] / total) if total > 0 else None


def latent_parts(fit: LaplaceFit, counts: dict[str, int], kind: str = "Erho2") -> tuple[np.ndarray, np.ndarray]:
    """Universe and error covariance of the latent values at one allocation."""
    from .fit import weights

    if CALL in fit.components:
        raise SpecError("ordinary coefficients are not defined when the call is a source; use the batch operators")
    w, col = weights(fit.design, counts), 1 if kind == "Erho2" else 2
    at = fit.components | {"Residual": fit.residual()}
    return sum(w[s][0] * m for s, m in at.items()), sum(w[s][col] * m for s, m in at.items())


def coefficient_error(fit: LaplaceFit, counts: dict[str, int], kind: str = "Erho2", latent: int = 0) -> float | None:
    """Delta standard error of ``latent_coefficient``."""
    from .fit import weights

    if fit.entry_covariance is None:
        return None
    u, e = (float(m[latent, latent]) for m in latent_parts(fit, counts, kind))
    w, col = weights(fit.design, counts), 1 if kind == "Erho2" else 2
    g = np.array([(w[s][0] * e - u * w[s][col]) / (u + e) ** 2 if i == j == latent else 0.0 for s, i, j in fit.entry_names])
    return float(np.sqrt(max(0.0, g @ fit.entry_covariance @ g)))


def nominal_error(fit: LaplaceFit, counts: dict[str, int], kind: str = "Erho2") -> float | None:
    """Delta standard error of the mean generalised eigenvalue, by differences along the component entries."""
    from .fit import weights

    if fit.entry_covariance is None:
        return None
    w, col = weights(fit.design, counts), 1 if kind == "Erho2" else 2
    at = fit.components | {"Residual": fit.residual()}

    def mean(parts) -> float:
        values = nominal_eigenvalues(sum(w[s][0] * m for s, m in parts.items()), sum(w[s][col] * m for s, m in parts.items()))
        return np.nan if values is None else float(values.mean())

    g = np.zeros(len(fit.entry_names))
    for k, (s, i, j) in enumerate(fit.entry_names):
        side = []
        for h in (1e-5, -1e-5):
            m = at[s].copy()
            m[i, j] += h
            if i != j:
                m[j, i] += h
            side.append(mean(at | {s: m}))
        g[k] = (side[0] - side[1]) / 2e-5
    return float(np.sqrt(max(0.0, g @ fit.entry_covariance @ g)))


def nominal_eigenvalues(universe: np.ndarray, error: np.ndarray) -> np.ndarray | None:
    """Generalised eigenvalues of U against U + E, by Cholesky whitening, in descending order."""
    try:
        root = np.linalg.cholesky(universe + error)
    except np.linalg.LinAlgError:
        return None
    inv = np.linalg.inv(root)
    return np.sort(np.clip(np.linalg.eigvalsh(inv @ universe @ inv.T), 0, 1))[::-1]


#: Share of the draws that come from the prior (fixed value); it bounds the weights.
PRIOR_SHARE = 0.1
MAX_CHECK_DIM = 3000


def log_weights(spark: SparkSession, fit: LaplaceFit, draws: int = 4000, seed: int = 1) -> DataFrame:
    """log_weight of each draw from 0.9 Gaussian at the fit's conditional mode and 0.1 prior: the likelihood is the weights' mean.

    A draw depends on seed and number only, so retries agree.
    """
    problem = fit.problem
    if problem.total > MAX_CHECK_DIM:
        raise SpecError(f"the check takes at most {MAX_CHECK_DIM} random effects")
    hessian, mode = problem.hessian(fit.x)
    fixed, factors = problem.unpack(fit.x)
    root = np.linalg.cholesky(hessian)
    log_det = float(np.log(np.diag(root)).sum())
    size = problem.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in b.column(0).to_pylist():
                rng = np.random.default_rng([seed, i])
                z, prior = rng.standard_normal(size), rng.random() < PRIOR_SHARE
                u = z if prior else mode + np.linalg.solve(root.T, z)
                gap = root.T @ (u - mode)
                # densities without the constant that both have
                proposal = np.logaddexp(np.log(1 - PRIOR_SHARE) + log_det - 0.5 * gap @ gap, np.log(PRIOR_SHARE) - 0.5 * u @ u)
                out.append(float(-problem.loss(u, fixed, factors) - proposal))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["log_weight"])

    return spark.range(draws).mapInArrow(run, "log_weight double")


def gauss_hermite(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights for the mean of a function of a standard normal value."""
    x, w = np.polynomial.hermite_e.hermegauss(n)
    return x, w / w.sum()


MAX_QUADRATURE_DIM = 4


def quadrature_check(fit: LaplaceFit, nodes: int = 15, max_evaluations: int = 200_000) -> tuple[float, float]:
    """Twice the negative log likelihood by Laplace and by adaptive Gauss-Hermite quadrature around the mode, for at most four random effects."""
    problem = fit.problem
    if problem.total > MAX_QUADRATURE_DIM or nodes**problem.total > max_evaluations:
        raise SpecError(f"quadrature takes at most {MAX_QUADRATURE_DIM} random effects and {max_evaluations} evaluations")
    hessian, mode = problem.hessian(fit.x)
    fixed, factors = problem.unpack(fit.x)
    root = np.linalg.cholesky(hessian)
    x, w = gauss_hermite(nodes)
    grids = np.stack(np.meshgrid(*[x] * problem.total, indexing="ij"), -1).reshape(-1, problem.total)
    logs = np.log(np.stack(np.meshgrid(*[w] * problem.total, indexing="ij"), -1).reshape(-1, problem.total)).sum(1)
    values = np.array([lw + 0.5 * z @ z - problem.loss(mode + np.linalg.solve(root.T, z), fixed, factors) for z, lw in zip(grids, logs, strict=True)])
    top = values.max()
    refined = top + np.log(np.exp(values - top).sum()) - np.log(np.diag(root)).sum()
    return 2 * fit.nll, -2 * float(refined)


def laplace_check(spark: SparkSession, fit: LaplaceFit, draws: int = 4000, seed: int = 1) -> DataFrame:
    """One row: twice the negative log likelihood by Laplace and by importance sampling at the fitted parameters, their difference and its Monte Carlo error."""
    got = importance_check(log_weights(spark, fit, draws, seed))
    at, n = F.lit(2 * fit.nll), F.col("draws")
    error = 2 * F.sqrt(F.greatest(n / F.col("effective") - 1, F.lit(0.0)) / (n - 1))
    return got.select(at.alias("laplace_minus2loglik"), (-2 * F.col("log_mean")).alias("refined_minus2loglik"), (at + 2 * F.col("log_mean")).alias("difference"), error.alias("mc_se"), "effective", "draws", (F.col("effective") >= F.greatest(F.lit(200.0), 0.1 * n)).alias("usable"))


def importance_check(log_weights: DataFrame, column: str = "log_weight") -> DataFrame:
    """One row: log of the mean weight and the effective sample size, by log-sum-exp on aggregates."""
    top = log_weights.agg(F.max(column).alias("__top"))
    w = F.exp(F.col(column) - F.col("__top"))
    s = log_weights.crossJoin(F.broadcast(top)).agg(F.first("__top").alias("t"), F.sum(w).alias("a"), F.sum(w * w).alias("b"), F.count("*").alias("draws"))  # one row
    return s.select((F.col("t") + F.log(F.col("a") / F.col("draws"))).alias("log_mean"), (F.col("a") * F.col("a") / F.col("b")).alias("effective"), "draws")
