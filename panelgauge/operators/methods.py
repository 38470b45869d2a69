"""What a fit can be asked for: counts, likelihood, coefficients, covariance, summaries, diagnostics, retention, and small text helpers."""

from __future__ import annotations

import math
from dataclasses import replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..spec import CALL, Control, Design, SpecError, model_formula
from .fit import Fit
from .laplace import LaplaceFit


def is_gaussian(fit: Any) -> bool:
    return isinstance(fit, Fit)


def require_fit(fit: Any) -> Any:
    if not isinstance(fit, (Fit, LaplaceFit)):
        raise SpecError("a fit is needed")
    return fit


def nobs(fit: Fit | LaplaceFit) -> int:
    """Observed rows (of one outcome)."""
    return fit.prepared.rows if is_gaussian(fit) else int(fit.problem.n.sum())


def degrees_of_freedom(fit: Fit | LaplaceFit) -> int:
    """Covariance parameters; means or cuts are added for ML and discrete fits."""
    if is_gaussian(fit):
        return fit.parameters + (len(fit.outcomes) if fit.estimator == "ML" else 0)
    return fit.problem.parameters


def deviance(fit: Fit | LaplaceFit) -> float:
    return fit.deviance if is_gaussian(fit) else 2 * fit.nll


def log_likelihood(fit: Fit | LaplaceFit) -> tuple[float, int]:
    """The (restricted) log likelihood and its degrees of freedom."""
    return -deviance(fit) / 2, degrees_of_freedom(fit)


def coef(fit: LaplaceFit | Fit) -> dict[str, float]:
    """Cuts and intercepts of a discrete fit; a Gaussian fit's means are not kept by its strata."""
    if is_gaussian(fit):
        raise SpecError("the strata hold no means")
    out = {}
    for b, at in zip(fit.blocks, fit.fixed, strict=True):
        names = [f"{b.name}[{x}]" for x in b.levels[1:]] if b.family.family == "categorical" else [f"{b.name}|{i + 1}" for i in range(b.parameters)]
        out |= dict(zip(names, map(float, at), strict=True))
    return out


def vcov(fit: Any) -> None:
    """Refused: whose covariance is meant must be said."""
    raise SpecError("use component_vcov(fit) for the components' covariance")


def component_vcov(fit: Fit | LaplaceFit) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Entries (source, row, column) and their delta covariance; entries of sources at the boundary are left out."""
    if fit.entry_covariance is None:
        raise SpecError("no covariance of the components is available")
    return fit.entry_names, fit.entry_covariance


def components(spark: SparkSession, fit: Fit | LaplaceFit, correlation: bool = False, tolerance: float = 1e-8) -> DataFrame:
    """source, row, col, component, or correlations with null where a variance is not above the tolerance."""
    t = fit.table(spark)
    if not correlation:
        return t
    from .strata import correlations

    return correlations(t, tolerance)


def usable(fit: Fit | LaplaceFit) -> tuple[bool, str]:
    """Whether coefficients may be taken from the fit, else the first stage that failed."""
    failed = [f"{n}: {d}" if d else n for n, s, d in fit.stages if s == "failed"]
    return fit.accepted, "" if fit.accepted else (failed[0] if failed else "not accepted")


#: Names of the staged diagnostics, in their order.
STAGES = ("finite_objective", "boundary_escape", "stationarity", "independent_objective", "second_start", "restart_stability", "solve_validity", "boundary", "observed_information")


def diagnostics(spark: SparkSession, fit: Fit | LaplaceFit) -> DataFrame:
    """stage, status (passed, failed, inconclusive or not_assessed) and reason of every stage."""
    known = {n: (s, d) for n, s, d in fit.stages}
    return spark.createDataFrame([(n, *known.get(n, ("not_assessed", "of another engine"))) for n in STAGES], "stage string, status string, reason string")


def ledger(spark: SparkSession, fit: LaplaceFit) -> DataFrame:
    """kind, detail, times: points that a discrete fit refused, with the evaluations it made."""
    counts: dict[tuple[str, str], int] = {("evaluations", ""): fit.evaluations}
    for f in fit.problem.failures:
        counts[f] = counts.get(f, 0) + 1
    return spark.createDataFrame([(*k, n) for k, n in counts.items()], "kind string, detail string, times long")


def context(fit: Fit | LaplaceFit, scale: str | None = None) -> str:
    """The scale on which coefficients may be taken: observed for a Gaussian fit, latent for a discrete one; a fit must be usable and its call no source."""
    ok, why = usable(require_fit(fit))
    if not ok:
        raise SpecError(f"the fit can't be used: {why}")
    if CALL in fit.components:
        raise SpecError("ordinary coefficients are not defined when the call is a source; use the batch operators")
    own = "observed" if is_gaussian(fit) else "latent"
    if scale not in (None, own):
        raise SpecError(f"this fit's coefficients are on the {own} scale")
    return own


def attempts(spark: SparkSession, fit: Fit) -> DataFrame:
    """The retry log: attempt, objective, stationarity, accepted."""
    return spark.createDataFrame(fit.attempts, "attempt long, objective double, stationarity double, accepted boolean")


def summary(spark: SparkSession, fit: Fit | LaplaceFit) -> DataFrame:
    """source, outcome, variance, share of the outcome's total, standard error."""
    names = fit.outcomes if is_gaussian(fit) else fit.latent_names
    parts = dict(fit.components) if is_gaussian(fit) else fit.components | {"Residual": fit.residual()}
    errors = {} if fit.entry_covariance is None else dict(zip(fit.entry_names, np.sqrt(np.clip(np.diag(fit.entry_covariance), 0, None)).tolist(), strict=True))
    total = sum(np.diag(m) for m in parts.values())
    rows = [(s, o, float(m[i, i]), float(m[i, i] / total[i]), errors.get((s, i, i))) for s, m in parts.items() for i, o in enumerate(names)]
    return spark.createDataFrame(rows, "source string, outcome string, variance double, share double, se double")


def describe(fit: Fit | LaplaceFit, digits: int = 4, lines: int = 20) -> str:
    """A short text: what was fitted, whether it was accepted, and the variances (at most so many lines)."""
    ok, why = usable(fit)
    names = fit.outcomes if is_gaussian(fit) else fit.latent_names
    head = [f"{fit.estimator if is_gaussian(fit) else 'Laplace'} fit of {', '.join(names)}: {'accepted' if ok else 'refused, ' + why}", f"{nobs(fit)} rows, {degrees_of_freedom(fit)} parameters, deviance {deviance(fit):.{digits}f}"]
    body = [f"  {quoted(s)}: " + ", ".join(f"{m[i, i]:.{digits}f}" for i in range(len(m))) for s, m in fit.components.items()]
    return "\n".join(head + body[:lines] + ([f"  ... {len(body) - lines} more sources"] if len(body) > lines else []))


def retained(fit: Fit, control: Control) -> Fit:
    """The fit without what the control does not keep: ``model`` (the strata) and ``retry_log``. Rows are never in a fit."""
    out = replace(fit)
    if "model" not in control.retain:
        out = replace(out, prepared=replace(fit.prepared, sscp={0: fit.prepared.sscp[0] * 0, **{k: v * np.nan for k, v in fit.prepared.sscp.items() if k}}))
    if "retry_log" not in control.retain:
        out = replace(out, attempts=[])
    return out


def arguments(first: Any, second: Any = None) -> tuple[DataFrame, str | None, Any]:
    """(panel, formula, rest) from a panel first or a formula first: ``f(panel, outcomes)``, ``f(panel, "y ~ a * b")`` or ``f("y ~ a * b", panel)``."""
    if isinstance(first, str) and "~" in first:
        if not isinstance(second, DataFrame):
            raise SpecError("a formula needs a panel after it")
        return second, first, None
    if not isinstance(first, DataFrame):
        raise SpecError("give a panel, or a formula and a panel")
    return (first, second, None) if isinstance(second, str) and "~" in second else (first, None, second)


def recorded_call(name: str, **given: Any) -> str:
    """The call as text: declarations by their values, panels by their columns."""
    show = lambda v: f"panel[{', '.join(v.columns)}]" if isinstance(v, DataFrame) else repr(v.terms and list(v.terms)) if isinstance(v, Design) else repr(v)
    return f"{name}({', '.join(f'{k}={show(v)}' for k, v in given.items() if v is not None)})"


def updated(call: dict[str, Any], **changes: Any) -> dict[str, Any]:
    """A call's arguments with some replaced; a new formula replaces outcomes and design."""
    out = call | changes
    if "formula" in changes:
        out["outcomes"], out["design"] = model_formula(changes["formula"], out.get("measured"))
    return out


def formula_of(design: Design, outcomes: list[str]) -> str:
    """The model formula that declares the same sources."""
    left = outcomes[0] if len(outcomes) == 1 else f"cbind({', '.join(outcomes)})"
    return f"{left} ~ {' + '.join(design.terms)}"


def item_key(value: Any) -> str:
    """A text key of an item that tells all numbers apart; 0 and -0 are one, whole numbers read alike as integers and doubles."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, float) and (math.isnan(value) or math.isinf(value)):
        raise SpecError("an item's number must be finite")
    return format(int(value), "d") if float(value).is_integer() and abs(value) < 2**53 else format(float(value), ".17g")


def quoted(name: str) -> str:
    """A name as it stands, or in backticks where it is no plain identifier."""
    return name if all(p.isidentifier() for p in name.split(":")) else "`" + name.replace("`", "``") + "`"


def aligned(matrix: np.ndarray, names: list[str], wanted: list[str]) -> np.ndarray:
    """A matrix with rows and columns in the wanted order of names."""
    if sorted(names) != sorted(wanted) or len(set(names)) != len(names):
        raise SpecError(f"names {names} do not match {wanted}")
    at = [names.index(n) for n in wanted]
    return np.asarray(matrix)[np.ix_(at, at)]


def stratum_root(sscp: np.ndarray) -> np.ndarray:
    """An upper-triangular root R with R'R = SSCP, from its eigenvalues so that a singular stratum has one, too."""
    values, vectors = np.linalg.eigh(sscp)
    return np.linalg.qr((vectors * np.sqrt(np.clip(values, 0, None))).T)[1]
