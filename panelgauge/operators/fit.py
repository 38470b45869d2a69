"""Gaussian fits from strata: one Spark job for the sums of products, then a small optimisation on the driver.

The likelihood of a balanced panel needs only the 2^k strata. Components are
lower-triangular factors (one per source), so every visited point is positive
semidefinite and a variance of zero is a legal boundary.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log, pi

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import CALL, RESIDUAL, Control, Design, Score, SpecError, model_formula
from . import audit, strata


@dataclass
class Prepared:
    axes: list[str]
    outcomes: list[str]
    levels: list[int]
    df: dict[int, float]
    sscp: dict[int, np.ndarray]

    @property
    def rows(self) -> int:
        return int(np.prod(self.levels))


@dataclass
class Fit:
    """Components with the facts of their acceptance."""

    design: Design
    outcomes: list[str]
    estimator: str
    components: dict[str, np.ndarray]
    deviance: float
    accepted: bool
    iterations: int
    gradient: float
    prepared: Prepared
    entry_names: list[tuple[str, int, int]] = field(default_factory=list)
    entry_covariance: np.ndarray | None = None
    stages: list[tuple[str, str, str]] = field(default_factory=list)
    attempts: list[tuple[int, float, float, bool]] = field(default_factory=list)  # number, objective, stationarity, accepted
    parameters: int = 0
    masks: dict[str, int] = field(default_factory=dict)

    @property
    def boundary(self) -> dict[str, str]:
        """interior, singular (a direction without variance) or zero, for each source."""
        top = max(float(np.diag(m).max()) for m in self.components.values())
        kind = lambda m: "zero" if float(np.diag(m).max()) <= 1e-6 * top else "singular" if np.linalg.eigvalsh(m)[0] <= 1e-6 * float(np.diag(m).max()) else "interior"
        return {s: kind(m) for s, m in self.components.items()}

    def table(self, spark) -> DataFrame:
        """source, row, col, component: the long form that the reliability operators join."""
        rows = [(s, a, b, float(m[i, j])) for s, m in self.components.items() for i, a in enumerate(self.outcomes) for j, b in enumerate(self.outcomes) if i <= j]
        return spark.createDataFrame(rows, "source string, row string, col string, component double")


def prepare(panel: DataFrame, outcomes: list[str], axes: list[str], control: Control = Control()) -> Prepared:
    """Checks of the complete panel and its strata: at most 2**max_axes small rows reach the driver."""
    if len(axes) > control.max_axes:
        raise SpecError("too many axes for the factorial strata")
    audit.reject_nulls(panel, [*axes, *outcomes])
    facts = audit.completeness(panel, axes).first()
    if not facts["balanced"]:
        raise SpecError("the exact engine needs a complete panel with one row per cell")
    if len(outcomes) != len(set(outcomes)):
        raise SpecError("outcomes must be distinct")
    d = len(outcomes)
    df, sscp, levels = {}, {}, None
    for r in strata.strata(panel, outcomes, axes).collect():
        m = sscp.setdefault(r["mask"], np.zeros((d, d)))
        i, j = outcomes.index(r["row"]), outcomes.index(r["col"])
        m[i, j] = m[j, i] = r["sscp"]
        df[r["mask"]] = float(r["df"])
        levels = [r[f"n{k}"] for k in range(len(axes))]
    if min(levels) < 2:
        raise SpecError("every axis needs two levels")
    total = sum(v for k, v in sscp.items() if k)
    if (np.diag(total) <= 0).any():
        raise SpecError("an outcome is constant")
    return Prepared(axes, outcomes, levels, df, sscp)


#: Axes that an object is split into when its calls are modelled.
BATCH, SLOT = "batch", "slot"


def source_masks(design: Design, axes: list[str]) -> dict[str, int]:
    """Bits of the axes of each source. With modelled calls the object is batch and slot, and the call is a batch under all facets."""
    if SLOT not in axes or SLOT in design.variables:
        return {s: sum(1 << axes.index(a) for a in m) for s, m in design.terms.items()}
    bit = lambda m: (1 << axes.index(BATCH)) | (1 << axes.index(SLOT)) if m == design.object else 1 << axes.index(m)
    out = {s: sum(bit(a) for a in m) for s, m in design.terms.items()}
    return out | {CALL: (1 << axes.index(BATCH)) | sum(bit(f) for f in design.facets)}


def batched_panel(panel: DataFrame, design: Design, layout: DataFrame) -> DataFrame:
    """The panel by batch and slot: each item's batch from the layout (item, batch), its slot by item within the batch."""
    if {BATCH, SLOT} & set(design.variables):
        raise SpecError("batch and slot are reserved when calls are modelled")
    placed = layout.withColumn(SLOT, F.row_number().over(Window.partitionBy(BATCH).orderBy("item")))  # a batch holds one request's items
    return panel.join(placed.withColumnRenamed("item", design.object), design.object)


def check_components(components: dict[str, np.ndarray], sources: list[str], outcomes: list[str]) -> dict[str, np.ndarray]:
    """Symmetric positive semidefinite matrices for exactly these sources, in their order."""
    if set(components) != set(sources):
        raise SpecError(f"components must name the sources {sources}")
    out = {}
    for s in sources:
        m = np.asarray(components[s], float)
        if m.shape != (len(outcomes),) * 2 or not np.isfinite(m).all() or np.abs(m - m.T).max() > 1e-8 * (1 + np.abs(m).max()) or np.linalg.eigvalsh(m)[0] < -1e-8 * (1 + np.abs(m).max()):
            raise SpecError(f"the matrix of {s} is not symmetric and positive semidefinite over {outcomes}")
        out[s] = (m + m.T) / 2
    return out


def independent_deviance(p: Prepared, components: dict[str, np.ndarray], masks: dict[str, int], reml: bool) -> float:
    """The same likelihood by eigenvalues: each stratum's covariance is summed source by source and taken apart."""
    d, total = len(p.outcomes), 0.0
    for mask, ss in p.sscp.items():
        c = np.array(components[RESIDUAL], float)
        for s, bits in masks.items():
            if mask | bits == bits:
                repeat = 1
                for j, n in enumerate(p.levels):
                    if not bits & (1 << j):
                        repeat *= n
                c = c + repeat * np.asarray(components[s], float)
        values, vectors = np.linalg.eigh(c)
        if values[0] <= 0:
            return np.inf
        if mask or not reml:
            total += p.df[mask] * float(np.log(values).sum())
        if mask:
            total += float((np.einsum("ik,ij,jk->k", vectors, ss, vectors) / values).sum())
    return total + d * (p.rows - (1 if reml else 0)) * log(2 * pi) + (d * log(p.rows) if reml else 0.0)


def outside(mask: int, levels: list[int]) -> float:
    return float(np.prod([n for j, n in enumerate(levels) if not mask >> j & 1]))


def stratum_covariance(components: dict[str, np.ndarray], masks: dict[str, int], levels: list[int], mask: int) -> np.ndarray:
    out = components[RESIDUAL].copy()
    for s, g in masks.items():
        if g & mask == mask:
            out = out + outside(g, levels) * components[s]
    return out


def deviance(p: Prepared, components: dict[str, np.ndarray], masks: dict[str, int], reml: bool, gradient: bool = False):
    """-2 log likelihood, and its derivative by each source's matrix."""
    d = len(p.outcomes)
    total = (p.rows - reml) * d * log(2 * pi) + (d * log(p.rows) if reml else 0.0)
    slopes = {s: np.zeros((d, d)) for s in [*masks, RESIDUAL]}
    for mask, ss in p.sscp.items():
        if mask == 0 and reml:
            continue
        c = stratum_covariance(components, masks, p.levels, mask)
        sign, ld = np.linalg.slogdet(c)
        if sign <= 0:
            return (np.inf, slopes) if gradient else np.inf
        inv = np.linalg.inv(c)
        quad = ss if mask else np.zeros_like(ss)
        total += p.df[mask] * ld + float((inv * quad).sum())
        if gradient:
            g = p.df[mask] * inv - inv @ quad @ inv
            slopes[RESIDUAL] += g
            for s, m in masks.items():
                if m & mask == mask:
                    slopes[s] += outside(m, p.levels) * g
    return (total, slopes) if gradient else total


def moments(p: Prepared, masks: dict[str, int]) -> dict[str, np.ndarray]:
    """Raw moment estimates by back-substitution from the largest stratum; negatives stay."""
    full = (1 << len(p.axes)) - 1
    ms = {m: p.sscp[m] / p.df[m] for m in p.sscp if m}
    out = {RESIDUAL: ms[full]}
    held = {full: ms[full] * 0}
    for m in sorted((x for x in ms if x != full), key=lambda x: -bin(x).count("1")):
        above = out[RESIDUAL] + sum((outside(g, p.levels) * held[g] for g in held if g & m == m), np.zeros_like(ms[m]))
        held[m] = (ms[m] - above) / outside(m, p.levels)
    return {s: held.get(m, np.zeros_like(ms[full])) for s, m in masks.items()} | out


def _floor(m: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Nearest start with eigenvalues of at least 1e-3 in units of the observed deviations."""
    s = np.sqrt(scale)
    w, v = np.linalg.eigh(m / np.outer(s, s))
    return (v * np.maximum(w, 1e-3)) @ v.T * np.outer(s, s)


def _bfgs(f, x: np.ndarray, tolerance: float, most: int) -> tuple[np.ndarray, float, np.ndarray, int]:
    value, g = f(x)
    h = np.eye(len(x)) / max(1.0, np.abs(g).max())
    for step in range(1, most + 1):
        d = -h @ g
        if g @ d > -1e-300:
            h, d = np.eye(len(x)) / max(1.0, np.abs(g).max()), -g / max(1.0, np.abs(g).max())
        t = 1.0
        while True:
            y, gy = f(x + t * d)
            if np.isfinite(y) and y <= value + 1e-4 * t * (g @ d) or t < 1e-14:
                break
            t *= 0.5
        s, z = t * d, gy - g
        done = abs(value - y) <= tolerance * (1 + abs(value)) and np.abs(g @ s) <= tolerance * (1 + abs(value))
        if y < value:
            x, value, g = x + s, y, gy
        if s @ z > 1e-14 * np.sqrt((s @ s) * (z @ z)) and (s @ z) > 0:
            rho = 1 / (s @ z)
            a = np.eye(len(x)) - rho * np.outer(s, z)
            h = a @ h @ a.T + rho * np.outer(s, s)
        if done or t < 1e-14:
            break
    return x, value, g, step


STATIONARY, AGREE, ATTEMPTS = 1e-3, 1e-5, 10


def _factor_bases(kind: str, scale: np.ndarray) -> list[np.ndarray]:
    """Matrices whose weighted sum is a source's lower-triangular factor, in units of the outcomes' deviations."""
    d = len(scale)

    def unit(i, j):
        m = np.zeros((d, d))
        m[i, j] = scale[i]
        return m

    if kind == "pooled":
        return [np.eye(d) * float(np.sqrt((scale**2).mean()))]
    if kind not in ("unstructured", "diagonal"):
        raise SpecError("covariance is unstructured or diagonal, the residual also pooled")
    return [unit(i, j) for i in range(d) for j in range(i + 1) if kind == "unstructured" or i == j]


def fit_prepared(p: Prepared, design: Design, estimator: str = "REML", covariance: str | dict[str, str] = "unstructured", control: Control = Control(), residual: str | None = None, start: dict[str, np.ndarray] | None = None) -> Fit:
    """Fit by sources' factors. ``covariance``: one choice, or one by source; ``residual``: its own choice, pooled (equal variances) included.

    Attempts start from the moments, from a smaller multiple of them and then from seeded
    shifts of the best point; the first accepted one wins, and a second start checks it.
    """
    if estimator not in ("REML", "ML"):
        raise SpecError("estimator is REML or ML")
    reml = estimator == "REML"
    masks = source_masks(design, p.axes)
    names = [*masks, RESIDUAL]
    chosen = dict.fromkeys(names, covariance) if isinstance(covariance, str) else {s: covariance.get(s, "unstructured") for s in names}
    if not isinstance(covariance, str) and set(covariance) - set(names):
        raise SpecError(f"covariance names no source: {sorted(set(covariance) - set(names))}")
    if any(v not in ("unstructured", "diagonal") for v in chosen.values()):
        raise SpecError("covariance is unstructured or diagonal")
    if residual is not None:
        if residual not in ("unstructured", "diagonal", "pooled"):
            raise SpecError("residual is unstructured, diagonal or pooled")
        chosen[RESIDUAL] = residual
    d = len(p.outcomes)
    var = np.diag(sum(v for k, v in p.sscp.items() if k)) / (p.rows - 1)
    scale = np.sqrt(var)
    bases = {s: np.array(_factor_bases(chosen[s], scale)) for s in names}
    bounds = np.cumsum([0, *[len(b) for b in bases.values()]])
    if bounds[-1] > control.max_parameters:
        raise SpecError("too many covariance parameters")

    def matrices(x: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        roots = {s: np.tensordot(x[bounds[k] : bounds[k + 1]], bases[s], 1) for k, s in enumerate(names)}
        return roots, {s: r @ r.T for s, r in roots.items()}

    def f(x: np.ndarray):
        roots, comps = matrices(x)
        value, slopes = deviance(p, comps, masks, reml, True)
        return value, np.concatenate([np.tensordot(bases[s], 2 * slopes[s] @ roots[s], 2) for s in names])

    def coordinates(m: np.ndarray, s: str) -> list[float]:
        root = np.linalg.cholesky(_floor(m, var))
        return [float((root * b).sum() / (b * b).sum()) for b in bases[s]]

    first = check_components(start, names, p.outcomes) if start is not None else moments(p, masks)
    x0 = np.concatenate([coordinates(first[s], s) for s in names])
    rng = np.random.default_rng(20240911)
    best, attempts, ends = None, [], []
    for n in range(ATTEMPTS):
        begin = x0 * (1.0, 0.6)[n] if n < 2 else best[0] * (1 + 0.2 * rng.standard_normal(len(x0)))
        x, value, g, steps = _bfgs(f, begin, control.tolerance, control.max_iterations)
        _, comps = matrices(x)
        again = independent_deviance(p, comps, masks, reml)
        stationary = float(np.abs(g).max() / (1 + abs(value)))
        good = bool(np.isfinite(value) and stationary < STATIONARY and abs(again - value) <= AGREE * (1 + abs(value)))
        attempts.append((n + 1, float(value), stationary, good))
        ends.append(value)
        if best is None or (good, -again) > (best[4], -best[5]):
            best = (x, value, stationary, steps, good, again)
        if n and best[4]:
            break
    x, value, stationary, steps, good, again = best
    _, comps = matrices(x)
    fit = Fit(design, p.outcomes, estimator, comps, float(value), good, steps, stationary, p, attempts=attempts, parameters=int(bounds[-1]), masks=masks)
    agree = abs(ends[0] - ends[1]) <= 1e-4 * (1 + abs(value))
    status = lambda ok: "passed" if ok else "failed"
    fit.stages = [
        ("finite_objective", status(np.isfinite(value)), ""),
        ("stationarity", status(stationary < STATIONARY), f"{stationary:.2e}"),
        ("independent_objective", status(abs(again - value) <= AGREE * (1 + abs(value))), f"{again - value:.2e}"),
        ("second_start", "passed" if agree else "inconclusive", f"{len(attempts)} attempts"),
        ("boundary", "passed", ", ".join(f"{s}: {k}" for s, k in fit.boundary.items() if k != "interior")),
    ]
    _wald(fit, masks, reml)
    return fit


def _wald(fit: Fit, masks: dict[str, int], reml: bool) -> None:
    """Delta covariance of the component entries from the observed information; entries at the boundary are held and left out."""
    p, d = fit.prepared, len(fit.outcomes)
    top = max(float(np.diag(m).max()) for m in fit.components.values())
    entries = [(s, i, j) for s, m in fit.components.items() for i in range(d) for j in range(i + 1) if min(m[i, i], m[j, j]) > 1e-6 * top]

    def slope(comps):
        _, slopes = deviance(p, comps, masks, reml, True)
        return np.array([slopes[s][i, j] * (1 if i == j else 2) for s, i, j in entries])

    hess = np.zeros((len(entries), len(entries)))
    for k, (s, i, j) in enumerate(entries):
        h = 1e-4 * np.sqrt(fit.components[s][i, i] * fit.components[s][j, j])
        side = []
        for sign in (1, -1):
            c = {n: m.copy() for n, m in fit.components.items()}
            c[s][i, j] += sign * h
            if i != j:
                c[s][j, i] += sign * h
            side.append(slope(c))
        hess[k] = (side[0] - side[1]) / (2 * h)
    hess = (hess + hess.T) / 2
    if len(entries) and np.isfinite(hess).all() and np.linalg.eigvalsh(hess)[0] > 0:
        fit.entry_names, fit.entry_covariance = entries, 2 * np.linalg.inv(hess)


def fit_gaussian(panel: DataFrame, outcomes: list[str] | None = None, design: Design | None = None, formula: str | None = None, measured: str | None = None, estimator: str = "REML", covariance: str | dict[str, str] = "unstructured", control: Control = Control(), residual: str | None = None, start: dict[str, np.ndarray] | None = None, layout: DataFrame | None = None) -> Fit:
    """Fit by outcomes and design or by a model formula. With a layout (item, batch) the shared call is a source of its own."""
    if formula is not None:
        outcomes, design = model_formula(formula, measured)
    design = design.resolve("gaussian")
    axes = list(design.variables)
    if layout is not None:
        from .batches import eligibility

        if design.batch is None:
            raise SpecError("a layout needs a design with a batch declaration")
        facts = eligibility(layout, panel, axes, design.batch.size).first()
        if not facts["modelled"]:
            raise SpecError(f"the call can't be a source: {facts['reason']}")
        panel, axes = batched_panel(panel, design, layout), [BATCH, SLOT, *design.facets]
    return fit_prepared(prepare(panel, outcomes, axes, control), design, estimator, covariance, control, residual, start)


def weights(design: Design, counts: dict[str, int], fixed: tuple[str, ...] = ()) -> dict[str, tuple[float, float, float]]:
    """source -> (universe, relative, absolute) for one allocation."""
    out = {}
    for s, members in design.terms.items():
        inside = [m for m in members if m != design.object]
        w = 1 / float(np.prod([counts[m] for m in inside])) if inside else 1.0
        loose = set(inside) - set(fixed)
        if s == design.object:
            out[s] = (1.0, 0.0, 0.0)
        elif design.object in members:
            out[s] = (0.0, w, w) if loose else (w, 0.0, 0.0)
        else:
            out[s] = (0.0, 0.0, w if loose else 0.0)
    w = 1 / (float(np.prod([counts[f] for f in design.facets])) * design.replicates)
    out[RESIDUAL] = (0.0, w, w)
    return out


def coefficient(fit: Fit, counts: dict[str, int], outcome: str | None = None, score: Score | None = None, fixed: tuple[str, ...] = (), kind: str = "Erho2") -> tuple[float | None, float | None]:
    """A coefficient and its delta standard error at one allocation."""
    if not fit.accepted:
        raise SpecError("the fit was not accepted")
    if CALL in fit.components:
        raise SpecError("ordinary coefficients are not defined when the call is a source; use the batch operators")
    a = np.array([score.weights[o] for o in fit.outcomes]) if score else np.eye(len(fit.outcomes))[fit.outcomes.index(outcome or fit.outcomes[0])]
    w = weights(fit.design, counts, fixed)
    col = 1 if kind == "Erho2" else 2
    quad = {s: float(a @ m @ a) for s, m in fit.components.items()}
    u, e = sum(w[s][0] * q for s, q in quad.items()), sum(w[s][col] * q for s, q in quad.items())
    if u + e <= 0:
        return None, None
    if fit.entry_covariance is None:
        return u / (u + e), None
    g = np.array([(w[s][0] * e - u * w[s][col]) / (u + e) ** 2 * a[i] * a[j] * (1 if i == j else 2) for s, i, j in fit.entry_names])
    return u / (u + e), float(np.sqrt(max(0.0, g @ fit.entry_covariance @ g)))


def fitted_table(spark, fit: Fit, grid: list[dict[str, int]], scores: dict[str, Score] | None = None, fixed: tuple[str, ...] = (), observed: dict[str, int] | None = None, level: float = 0.95) -> DataFrame:
    """Coefficients of a fit over a bounded list of allocations, with delta standard errors and logit bounds: one row per allocation and outcome or score."""
    from .reliability import EXACT, logit_interval

    if len(grid) > 10_000:
        raise SpecError("too many candidate allocations")
    if fixed and (observed is None or any(g[f] != observed[f] for g in grid for f in fixed)):
        raise SpecError("a fixed facet keeps its observed count")
    facets = list(fit.design.facets)
    rows = []
    held = [s for s, k in fit.boundary.items() if k != "interior"]
    for n, counts in enumerate(grid, 1):
        many = float(np.prod([counts[f] for f in facets])) * fit.design.replicates
        for kind, name, score in [*[("outcome", o, None) for o in fit.outcomes], *[("composite", k, v) for k, v in (scores or {}).items()]]:
            g, gse = coefficient(fit, counts, name if score is None else None, score, fixed, "Erho2")
            phi, pse = coefficient(fit, counts, name if score is None else None, score, fixed, "Phi")
            weights_text = ", ".join(f"{o}: {w:g}" for o, w in score.weights.items()) if score else None
            extra = None if observed is None else any(counts[f] > observed[f] for f in facets)
            rows.append((n, kind, name, g, gse, phi, pse, *[counts[f] for f in facets], "observed", level, "delta" if gse is not None else "none", ", ".join(held) or None, ", ".join(fixed) or None, weights_text, many, many < EXACT, extra, "declared" if fit.design.batch else "none"))
    ddl = "design_id long, kind string, outcome string, Erho2 double, Erho2_se double, Phi double, Phi_se double, " + "".join(f"allocation_{f} long, " for f in facets)
    ddl += "scale string, interval_level double, uncertainty_source string, uncertainty_given string, fixed_facets string, composite_weights string, measurements_per_object double, measurement_count_exact boolean, extrapolated boolean, batch_status string"
    t = spark.createDataFrame(rows, ddl)
    for c in ("Erho2", "Phi"):
        lo, hi = logit_interval(F.col(c), F.col(f"{c}_se"), level)
        t = t.withColumns({f"{c}_lower": lo, f"{c}_upper": hi}).withColumn(f"{c}_interval_available", F.col(f"{c}_lower").isNotNull())
    return t


@dataclass
class ObservedFit:
    """Components of one outcome on observed cells, with the facts of their acceptance. Coefficients are projections to a balanced study."""

    design: Design
    estimator: str
    components: dict[str, float]
    mean: float
    deviance: float
    accepted: bool
    rows: int
    stages: list[tuple[str, str, str]]

    def coefficient(self, counts: dict[str, int], kind: str = "Erho2", projection: str | None = None) -> float | None:
        if projection != "balanced":
            raise SpecError("an observed-row fit has no balanced study of its own: ask for projection='balanced'")
        if not self.accepted:
            raise SpecError("the fit was not accepted")
        w, col = weights(self.design, counts), 1 if kind == "Erho2" else 2
        u, e = sum(w[s][0] * v for s, v in self.components.items()), sum(w[s][col] * v for s, v in self.components.items())
        return u / (u + e) if u + e > 0 else None


def fit_observed_rows(rows: list[tuple], values: list[float], design: Design, estimator: str = "REML", control: Control = Control()) -> ObservedFit:
    """One outcome on the observed cells of an incomplete panel: dense kernels, at most max_rows_observed rows.

    Sources must be told apart by their kernels; a second start and the slope decide on acceptance.
    """
    n = len(values)
    if n > control.max_rows_observed:
        raise SpecError("too many rows for the observed-row engine")
    if estimator not in ("REML", "ML"):
        raise SpecError("estimator is REML or ML")
    y = np.asarray(values, float)
    if not np.isfinite(y).all() or n < 3 or y.max() == y.min():
        raise SpecError("the outcome must be finite and vary")
    if len(set(rows)) != n:
        raise SpecError("a cell is observed twice")
    at = {v: i for i, v in enumerate(design.variables)}
    kernels = {}
    for s, members in design.terms.items():
        codes = {}
        g = np.array([codes.setdefault(tuple(r[at[m]] for m in members), len(codes)) for r in rows])
        kernels[s] = (g[:, None] == g[None, :]).astype(float)
    kernels[RESIDUAL] = np.eye(n)
    # kernels centred on the mean must be independent
    centre = np.eye(n) - 1 / n
    flat = np.stack([(centre @ k @ centre).ravel() for k in kernels.values()])
    scale = np.sqrt((flat**2).sum(1))
    gram = flat @ flat.T / np.outer(np.maximum(scale, 1e-300), np.maximum(scale, 1e-300))
    rank = int((np.linalg.eigvalsh(gram) > 1e-9).sum())
    if rank < len(kernels):
        raise SpecError(f"the observed cells tell {rank} of {len(kernels)} sources apart")
    names, one, reml = list(kernels), np.ones(n), estimator == "REML"
    unit = float(y.std(ddof=1))
    z = (y - y.mean()) / unit

    def f(x):
        v = sum(x[k] ** 2 * kernels[s] for k, s in enumerate(names))
        sign, ld = np.linalg.slogdet(v)
        if sign <= 0:
            return np.inf, np.zeros(len(x))
        inv = np.linalg.inv(v)
        c = inv @ one
        q = one @ c
        p = inv - np.outer(c, c) / q
        py = p @ z
        base = p if reml else inv
        value = (n - reml) * log(2 * pi) + ld + (log(q) if reml else 0.0) + z @ py
        return value, np.array([2 * x[k] * ((base * kernels[s]).sum() - py @ kernels[s] @ py) for k, s in enumerate(names)])

    runs = [_bfgs(f, np.full(len(names), sd / np.sqrt(len(names))), control.tolerance, control.max_iterations) for sd in (1.0, 0.5)]
    x, value, g, _ = min(runs, key=lambda r: r[1])
    stationary = float(np.abs(g).max() / (1 + abs(value)))
    agree = abs(runs[0][1] - runs[1][1]) <= 1e-5 * (1 + abs(value))
    v = sum(x[k] ** 2 * kernels[s] for k, s in enumerate(names))
    c = np.linalg.solve(v, one)
    shift = 2 * (n - reml) * log(unit)
    stages = [("finite_objective", "passed" if np.isfinite(value) else "failed", ""), ("stationarity", "passed" if stationary < STATIONARY else "failed", f"{stationary:.2e}"), ("second_start", "passed" if agree else "inconclusive", ""), ("kernel_identification", "passed", f"rank {rank}")]
    return ObservedFit(design, estimator, {s: float(x[k] ** 2 * unit**2) for k, s in enumerate(names)}, float(y.mean() + unit * (c @ z) / (c @ one)), float(value + shift), bool(np.isfinite(value) and stationary < STATIONARY), n, stages)


def fit_observed(rows: list[tuple], values: list[float], design: Design, estimator: str = "REML", control: Control = Control()) -> tuple[dict[str, float], float]:
    """Components and deviance of ``fit_observed_rows``."""
    found = fit_observed_rows(rows, values, design, estimator, control)
    return found.components, found.deviance
