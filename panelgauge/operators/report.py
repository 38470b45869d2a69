"""Versioned report snapshots and standalone HTML."""

from __future__ import annotations

import os
import tempfile
from html import escape
from math import exp, log
from statistics import NormalDist

from ..spec import SpecError
from . import charts
from .discrete import coefficient_error, latent_coefficient
from .fit import Fit, coefficient
from .laplace import LaplaceFit

VERSION = "1.0"


def snapshot(fit: Fit | LaplaceFit, counts: list[dict[str, int]], claimed: dict | None = None, checks: list | None = None, bootstrap: list[dict] | None = None, level: float = 0.95) -> dict:
    """Aggregates only, no rows and no level names. Claimed coefficients are recomputed and a mismatch is refused.

    ``checks``: preflight checks; ``bootstrap``: collected intervals of a bootstrap.
    """
    gaussian = isinstance(fit, Fit)
    names = fit.outcomes if gaussian else fit.latent_names
    if len(counts) > 1000:
        raise SpecError("a report takes at most 1000 allocations")
    table = []
    for c in counts:
        for i, o in enumerate(names):
            if gaussian:
                (g, se), (phi, _) = coefficient(fit, c, o), coefficient(fit, c, o, kind="Phi")
            else:
                g, se, phi = latent_coefficient(fit, c, "Erho2", i), coefficient_error(fit, c, "Erho2", i), latent_coefficient(fit, c, "Phi", i)
            lower = upper = None
            if g is not None and se and 0 < g < 1:
                z = NormalDist().inv_cdf((1 + level) / 2) * se / (g * (1 - g))
                lower, upper = (1 / (1 + exp(-(log(g / (1 - g)) + s * z))) for s in (-1, 1))
            table.append({"outcome": o, **c, "Erho2": g, "Erho2_se": se, "Erho2_lower": lower, "Erho2_upper": upper, "Phi": phi})
    if claimed:
        for row in table:
            key = (row["outcome"], *[row[f] for f in fit.design.facets])
            if key in claimed and abs(claimed[key] - row["Erho2"]) > 1e-8:
                raise SpecError(f"supplied coefficient for {key} does not match the fit")
    parts = fit.components if gaussian else fit.components | {"Residual": fit.residual()}
    comps = [{"source": s, "outcome": o, "variance": float(m[i, i])} for s, m in parts.items() for i, o in enumerate(names)]
    preflight = [{"check": n, "passed": p, "detail": d if n not in PRIVATE_CHECKS else ""} for n, p, d in checks or []]
    return {
        "version": VERSION, "estimator": fit.estimator if gaussian else "Laplace", "scale": "observed" if gaussian else "latent", "deviance": fit.deviance if gaussian else 2 * fit.nll, "accepted": fit.accepted, "level": level,
        "sources": list(fit.design.terms), "components": comps, "coefficients": table, "diagnostics": [{"stage": a, "status": b, "reason": c} for a, b, c in fit.stages], "preflight": preflight, "bootstrap": bootstrap or [],
    }


#: Checks whose detail names labels of the data.
PRIVATE_CHECKS = frozenset({"outcome_category_coverage"})


def _table(rows: list[dict]) -> str:
    if not rows:
        return "<p>none</p>"
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else escape(str(v))
    head = "".join(f"<th>{escape(k)}</th>" for k in rows[0])
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"


def export_html(report: dict, path: str, overwrite: bool = False) -> str:
    """One standalone file on the driver: written aside, then moved; an existing file is kept unless told otherwise."""
    if os.path.exists(path) and not overwrite:
        raise SpecError(f"{path} exists")
    body = f"<h1>Measurement report</h1><p>Version {escape(report['version'])}, {escape(report['estimator'])}, deviance {report['deviance']:.4f}</p><h2>Components</h2>{_table(report['components'])}<h2>Coefficients</h2>{charts.bars(report['coefficients'], 'outcome', 'Erho2', 'Erho2_lower', 'Erho2_upper')}{_table(report['coefficients'])}<h2>Diagnostics</h2>{_table(report['diagnostics'])}"
    for title, part in (("Preflight", "preflight"), ("Bootstrap", "bootstrap")):
        if report[part]:
            body += f"<h2>{title}</h2>{_table(report[part])}"
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".html")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Measurement report</title></head><body>{body}</body></html>')
    os.replace(tmp, path)
    return path
