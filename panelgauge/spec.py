"""Declarations: designs, formulas, families, scores, batches and controls. No Spark job runs here."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from itertools import combinations
from math import comb

RESIDUAL, CALL = "Residual", "Call"


class SpecError(ValueError):
    """A declaration or a panel that the operators refuse."""


def check_names(names, what: str, allow_empty: bool = False) -> list[str]:
    out = [names] if isinstance(names, str) else list(names or [])
    if not out and not allow_empty:
        raise SpecError(f"{what} must name at least one column")
    for n in out:
        if not isinstance(n, str) or not n or n != n.strip() or ":" in n or n in (RESIDUAL, CALL):
            raise SpecError(f"{what}: {n!r} is no legal column name")
    if len(set(out)) != len(out):
        raise SpecError(f"{what} must be unique")
    return out


def interaction_order(value, n: int, what: str) -> int:
    if value == "complete":
        return n
    if value == "additive":
        return 1
    if isinstance(value, int) and not isinstance(value, bool) and 1 <= value <= n:
        return value
    raise SpecError(f"{what} must be 'complete', 'additive' or an integer from 1 to {n}")


# ---------------------------------------------------------------- formulas

_LEX = re.compile(r"\s*(?:([A-Za-z_.][\w.]*)|([01])(?![\w.])|([-+:*/()~,^|]))")


def _lex(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise SpecError(f"unexpected character in formula at {text[at:at + 10]!r}")
        out.append(m[1] or m[2] or m[3])
        at = m.end()
    return out


class _Terms:
    """Recursive descent over + : * / ( ) and 0 1; terms are ordered sets of names."""

    def __init__(self, words: list[str], max_terms: int):
        self.words, self.at, self.most = words, 0, max_terms

    def peek(self) -> str | None:
        return self.words[self.at] if self.at < len(self.words) else None

    def distinct(self, terms: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
        out = {frozenset(t): tuple(dict.fromkeys(t)) for t in reversed(terms)}
        kept = [t for t in dict.fromkeys(frozenset(x) for x in terms)]
        if len(kept) > self.most:
            raise SpecError("formula expansion exceeds max_terms")
        return [out[k] for k in kept]

    def cross(self, a, b):
        if len(a) * len(b) > self.most:
            raise SpecError("formula expansion exceeds max_terms")
        return self.distinct([(*x, *y) for x in a for y in b])

    def sum(self):
        if self.peek() == "+":
            self.at += 1
        out = self.product()
        while self.peek() == "+":
            self.at += 1
            out = self.distinct(out + self.product())
        return out

    def product(self):
        out = self.interaction()
        while self.peek() in ("*", "/"):
            op = self.words[self.at]
            self.at += 1
            right = self.interaction()
            if op == "*":
                out = self.distinct(out + right + self.cross(out, right))
            else:
                joint = tuple(dict.fromkeys(n for t in out for n in t))
                if not joint:
                    raise SpecError("the left side of '/' must name a variable")
                out = self.distinct(out + self.cross([joint], right))
        return out

    def interaction(self):
        out = self.atom()
        while self.peek() == ":":
            self.at += 1
            out = self.cross(out, self.atom())
        return out

    def atom(self):
        word = self.peek()
        self.at += 1
        if word == "(":
            out = self.sum()
            if self.peek() != ")":
                raise SpecError("missing ) in formula")
            self.at += 1
            return out
        if word in ("0", "1"):
            return []
        if word is None or not re.match(r"[A-Za-z_.]", word):
            raise SpecError("only names, + : * / ( ) and 0 or 1 are allowed in a formula")
        return [(word,)]


def formula_terms(text: str, max_terms: int = 4096) -> list[tuple[str, ...]]:
    """The grouping terms of a one-sided formula such as ``~ item * rater``."""
    words = _lex(text)
    if words[:1] == ["~"]:
        words = words[1:]
    parser = _Terms(words, max_terms)
    out = parser.sum()
    if parser.peek() is not None:
        raise SpecError(f"unexpected {parser.peek()!r} in formula")
    return out


# ---------------------------------------------------------------- designs


@dataclass(frozen=True)
class Batch:
    """Items annotated together in one call."""

    size: int
    order: str | None = None
    by: str | None = None
    sequential: bool | None = None
    neighbor: bool | None = None
    id: str | None = None

    def __post_init__(self):
        if not isinstance(self.size, int) or isinstance(self.size, bool) or self.size < 2:
            raise SpecError("a batch holds at least two items")


@dataclass(frozen=True)
class Design:
    """Object, facets and the canonical random sources (by size, then name)."""

    object: str
    facets: tuple[str, ...]
    terms: dict[str, tuple[str, ...]]
    replicates: int = 1
    nested: dict[str, tuple[str, ...]] = field(default_factory=dict)
    construction: str = "crossed"
    aliased: tuple[str, ...] = ()
    batch: Batch | None = None
    notes: tuple[str, ...] = ()

    @property
    def variables(self) -> tuple[str, ...]:
        return (self.object, *self.facets)

    def scope(self, facet: str) -> tuple[str, ...]:
        """A facet with the facets that it is nested in."""
        seen: list[str] = []

        def walk(f):
            if f not in seen:
                seen.append(f)
                for p in self.nested.get(f, ()):
                    walk(p)

        walk(facet)
        return tuple(f for f in self.facets if f in seen)

    def resolve(self, family: str, replication: set[int] | None = None) -> Design:
        """Settle the full-cell source once family and observed replication are known."""
        if replication is not None and replication != {self.replicates}:
            raise SpecError("observed replication does not match the declared replicates")
        full = ":".join(self.variables)
        hit = full in self.terms and self.replicates == 1
        if hit and family != "gaussian":
            raise SpecError(f"source {full} is not identified for discrete outcomes with one row per cell; declare full_cell=False")
        if not hit:
            return self
        return replace(self, terms={k: v for k, v in self.terms.items() if k != full}, aliased=(full,))


def _subsets(values, order: int):
    return [c for k in range(1, order + 1) for c in combinations(values, k)]


def design(object: str, facets, crossed=None, nested: dict | None = None, item_interactions="complete", instrument_interactions="complete", item_nested=(), random=None, full_cell: bool = True, replicates: int = 1, max_terms: int = 4096, batch: Batch | None = None) -> Design:
    """Declare the object, its facets and the sources of variation."""
    object = check_names(object, "object")[0]
    facets = check_names(facets, "facets")
    if object in facets:
        raise SpecError("facets must not contain the object")
    if not isinstance(replicates, int) or isinstance(replicates, bool) or replicates < 1:
        raise SpecError("replicates must be a positive integer")
    variables = [object, *facets]
    if batch:
        if batch.by is not None and batch.by not in facets:
            raise SpecError("the batch's by must be a facet")
        if {batch.order, batch.id} & set(variables):
            raise SpecError("the batch's order and id must be other columns")
    scopes: dict[str, tuple[str, ...]] = {}
    if random is not None:
        if crossed is not None or nested or item_interactions != "complete" or instrument_interactions != "complete" or item_nested:
            raise SpecError("use random or the crossed and nested selectors, not both")
        if isinstance(random, str):
            groups = formula_terms(random, max_terms)
        else:
            groups = [tuple(p.strip() for p in t.split(":")) for t in random]
            keys = [frozenset(g) for g in groups]
            if not groups or any(len(set(g)) != len(g) or not all(g) for g in groups) or len(set(keys)) != len(keys):
                raise SpecError("random must hold distinct grouping terms")
        construction, nested = "custom", {}
    else:
        crossed = check_names(facets if crossed is None else crossed, "crossed")
        if set(crossed) - set(facets):
            raise SpecError("crossed must be a subset of the facets")
        crossed = [f for f in facets if f in crossed]
        nested = {k: tuple(check_names(v, f"parents of {k}")) for k, v in (nested or {}).items()}
        if set(nested) != set(facets) - set(crossed):
            raise SpecError("nested must give the parents of every facet that is not crossed")

        def close(node, active=()):
            if node in active:
                raise SpecError("nested facets form a cycle")
            if node in crossed:
                return {node}
            if node not in nested or node == object:
                raise SpecError(f"unknown parent facet {node}")
            return {node}.union(*(close(p, (*active, node)) for p in nested[node]))

        scopes = {c: tuple(f for f in facets if f in close(c)) for c in nested}
        if set(item_nested) - set(nested):
            raise SpecError("item_nested must name nested facets")
        n = len(crossed)
        inst, item = interaction_order(instrument_interactions, n, "instrument_interactions"), interaction_order(item_interactions, n, "item_interactions")
        if 1 + sum(comb(n, k) for k in range(1, inst + 1)) + sum(comb(n, k) for k in range(1, item + 1)) + len(nested) + len(item_nested) > max_terms:
            raise SpecError("interaction expansion exceeds max_terms")
        groups = [(object,), *_subsets(crossed, inst), *scopes.values(), *[(object, *s) for s in _subsets(crossed, item)], *[(object, *scopes[c]) for c in item_nested]]
        construction = "crossed_nested" if nested else "crossed"
    unknown = {n for g in groups for n in g} - set(variables)
    if unknown:
        raise SpecError(f"unknown variables in terms: {sorted(unknown)}")
    named = {}
    for g in groups:
        members = tuple(v for v in variables if v in g)
        named[":".join(members)] = members
    if not full_cell:
        named.pop(":".join(variables), None)
    if object not in named:
        raise SpecError("the object's own source is required")
    if len(named) > max_terms:
        raise SpecError("sources exceed max_terms")
    terms = dict(sorted(named.items(), key=lambda kv: (len(kv[1]), kv[0])))
    return Design(object, tuple(facets), terms, replicates, nested, construction, (), batch)


def model_formula(text: str, measured: str | None = None) -> tuple[list[str], Design]:
    """Outcomes and design of ``score ~ item * rater`` or ``cbind(a, b) ~ ...``."""
    if text.count("~") != 1:
        raise SpecError("a model formula needs outcomes on the left and sources on the right")
    left, right = (x.strip() for x in text.split("~"))
    m = re.fullmatch(r"cbind\(([^()]*)\)", left)
    outcomes = [x.strip() for x in m[1].split(",")] if m else [left]
    if not all(re.fullmatch(r"[A-Za-z_.][\w.]*", o) for o in outcomes):
        raise SpecError("the left side must name one outcome or cbind() several")
    variables = list(dict.fromkeys(n for t in formula_terms(right) for n in t))
    if len(variables) < 2:
        raise SpecError("the right side must name the object and at least one facet")
    object = variables[0] if measured is None else measured
    if object not in variables:
        raise SpecError("measured must be on the right side")
    return outcomes, design(object, [v for v in variables if v != object], random=right)


# ---------------------------------------------------------------- families, scores, control


@dataclass(frozen=True)
class Family:
    """gaussian(identity), binary and ordinal (probit or logit), categorical (softmax)."""

    family: str = "gaussian"
    link: str | None = None
    levels: tuple | None = None
    reference: str | None = None

    def __post_init__(self):
        links = {"gaussian": ("identity",), "binary": ("probit", "logit"), "ordinal": ("probit", "logit"), "categorical": ("softmax",)}
        if self.family not in links:
            raise SpecError(f"unknown family {self.family}")
        if self.link is None:
            object.__setattr__(self, "link", links[self.family][0])
        if self.link not in links[self.family]:
            raise SpecError(f"{self.family} has no link {self.link}")
        if self.levels is not None:
            object.__setattr__(self, "levels", tuple(self.levels))
            n = len(self.levels)
            if len(set(self.levels)) != n or (self.family == "binary" and n != 2) or (self.family in ("ordinal", "categorical") and n < 3) or self.family == "gaussian":
                raise SpecError("binary needs two distinct levels, ordinal and categorical at least three, gaussian none")
        if self.reference is not None and (self.family != "categorical" or (self.levels and self.reference not in self.levels)):
            raise SpecError("reference must be a level of a categorical family")


@dataclass(frozen=True)
class Score:
    """Composite weights; not normalised."""

    weights: dict[str, float]

    def __post_init__(self):
        if not self.weights or not any(self.weights.values()):
            raise SpecError("a score needs at least one weight that is not zero")


@dataclass(frozen=True)
class Control:
    """Limits and tolerances of the fitting engines (documented defaults)."""

    max_axes: int = 12
    max_rows_observed: int = 1000
    max_rows_discrete: int = 100_000
    max_random_dim: int = 40_000
    max_dense_dim: int = 4000
    max_bytes: int = 2 << 30
    max_parameters: int = 80
    tolerance: float = 1e-9
    max_iterations: int = 500
    retain: frozenset[str] = frozenset({"model", "retry_log"})
    specimen_dir: str | None = None  # where a failed linear-algebra operation leaves its inputs

    def __post_init__(self):
        for name in ("max_axes", "max_rows_observed", "max_rows_discrete", "max_random_dim", "max_dense_dim", "max_bytes", "max_parameters", "max_iterations"):
            value = getattr(self, name)
            if not isinstance(value, int) or isinstance(value, bool) or value < 1:
                raise SpecError(f"{name} must be a positive integer")
        if not 0 < self.tolerance < 1:
            raise SpecError("tolerance must lie between 0 and 1")
        if set(self.retain) - {"data", "model", "retry_log"}:
            raise SpecError("retain takes data, model and retry_log")
