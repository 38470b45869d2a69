"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to). A flow network routes words from patterns to source quotas: pattern ->
repetition tier (each tier holds the pattern's words once, the k-th repetition
costs more than the one before: convex costs) -> source. Successive shortest
paths give the cheapest routing, so a pattern repeats only when first copies
are used up. Within a pattern documents are taken in a seeded order.

Defined results
  null text            size 0
  null source          a source of its own, ranked last; in an array of sources null entries are dropped, an empty or null array counts as the null source
  null id              a document like any other; null ids share a draw
  repeated rows        separate documents; equal draws are ordered by id, then by the row's own key
  very long text       counted whole
  empty table          no rows
  size 0               taken 0
  other columns        those of ``keep`` come back in the struct ``kept``, whatever their names; the rest is ignored
The number of patterns and sources is bounded by ``max_patterns`` and checked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, write_cut

FINE = 4096
NULL_SOURCE = "\U0010ffff"


def quota_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """source -> target: shares by weight, capped at ``most`` times the source, the excess reshared until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: most * n for s, n in order}
    left = share * sum(n for _, n in order)
    out: dict[str | None, float] = {}
    free = [s for s, _ in order]
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = cap[s]
        left -= sum(cap[s] for s in over)
        free = [s for s in free if s not in out]
    return out


@dataclass
class _Edge:
    to: int
    room: float
    cost: float
    back: int


class MinCostFlow:
    """Successive shortest paths (Bellman-Ford) on a small graph."""

    def __init__(self, n: int):
        self.graph: list[list[_Edge]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, room: float, cost: float) -> tuple[int, int]:
        self.graph[a].append(_Edge(b, room, cost, len(self.graph[b])))
        self.graph[b].append(_Edge(a, 0.0, -cost, len(self.graph[a]) - 1))
        return a, len(self.graph[a]) - 1

    def run(self, source: int, sink: int, eps: float = 1e-6) -> float:
        total = 0.0
        while True:
            dist = [float("inf")] * len(self.graph)
            via: list[tuple[int, int] | None] = [None] * len(self.graph)
            dist[source] = 0.0
            queue = [source]
            while queue:
                nxt = []
                for a in queue:
                    for i, e in enumerate(self.graph[a]):
                        if e.room > eps and dist[a] + e.cost < dist[e.to] - 1e-12:
                            dist[e.to], via[e.to] = dist[a] + e.cost, (a, i)
                            nxt.append(e.to)
                queue = list(dict.fromkeys(nxt))
            if via[sink] is None:
                return total
            push, at = float("inf"), sink
            while at != source:
                a, i = via[at]
                push, at = min(push, self.graph[a][i].room), a
            at = sink
            while at != source:
                a, i = via[at]
                e = self.graph[a][i]
                e.room -= push
                self.graph[at][e.back].room += push
                at = a
            total += push


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, float], tiers: int = 2) -> dict[tuple[tuple[str, ...], str], float]:
    """(pattern, source) -> words routed. The k-th repetition of a pattern costs k squared a word."""
    names, pats = sorted(targets), sorted(patterns)
    n = 2 + len(pats) + len(names)
    flow = MinCostFlow(n)
    at = {s: 2 + len(pats) + i for i, s in enumerate(names)}
    links = {}
    for i, p in enumerate(pats):
        for k in range(tiers):
            flow.edge(0, 2 + i, float(patterns[p]), float(k * k))
        for s in p:
            links[p, s] = flow.edge(2 + i, at[s], tiers * float(patterns[p]), 0.0)
    for s in names:
        flow.edge(at[s], 1, float(targets[s]), 0.0)
    flow.run(0, 1)
    return {k: flow.graph[flow.graph[a][i].to][flow.graph[a][i].back].room for k, (a, i) in links.items()}


def take_copies(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs as often as the mix takes them: whole copies, at most ``tiers``; the document at a boundary is rounded."""
    got, _, _ = mix_sources(docs, sources, id_col, text_col, keep=tuple(docs.columns), **options)
    copies = F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    repeated = got.select("kept", F.explode(F.array_repeat(F.lit(1), copies)))
    return repeated.select(*[F.col("kept").getField(c).alias(c) for c in docs.columns])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, tiers: int = 2, max_patterns: int = 20_000, keep: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str | None, float], dict]:
    """Documents with what the mix takes of each, the targets, and the routing.

    ``sources`` is an array column of the sources a document belongs to. The
    rows have doc_id, row_key, pattern, size, taken and ``kept``, a struct of the columns of ``keep``.
    ``taken`` per pattern sums to the words routed out of it: whole copies in a
    seeded order, one document cut at the boundary.
    """
    spark = docs.sparkSession
    named = F.array_sort(F.array_distinct(F.filter(sources.cast("array<string>"), lambda x: x.isNotNull())))
    pattern = F.when(F.coalesce(F.size(named), F.lit(0)) < 1, F.array(F.lit(NULL_SOURCE))).otherwise(named)
    kept = F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]) if keep else F.lit(None).cast("struct<none: int>")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), word_count(F.col(f"`{text_col}`").cast("string")).alias("size"), pattern.alias("pattern"), kept.alias("kept")).withColumn("row_key", F.monotonically_increasing_id())
    base = base.withColumn("draw", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 10), 16, 10).cast("long"))
    base = write_cut(base, "mix")
    sums = base.groupBy("pattern").agg(F.sum("size").alias("n")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = {tuple(r["pattern"]): r["n"] for r in sums}
    sizes: dict[str, int] = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    total = sum(patterns.values())
    targets = quota_targets([(None if s == NULL_SOURCE else s, n) for s, n in sizes.items()], weights, share * total / max(1, sum(sizes.values())), float(tiers))
    routed = route(patterns, {NULL_SOURCE if s is None else s: t for s, t in targets.items()}, tiers)
    words = {p: 0.0 for p in patterns}
    for (p, _), x in routed.items():
        words[p] += x
    quota = [(list(p), int(words[p] // n) if n else 0, int(round(words[p] - (words[p] // n) * n)) if n else 0) for p, n in patterns.items()]
    q = spark.createDataFrame(quota, "pattern array<string>, whole int, part long")
    # place in the seeded order in two steps: sums of FINE slices of the draw, then a running sum inside the one slice that holds the boundary
    sliced = base.withColumn("slice", F.floor(F.col("draw") / F.lit((1 << 40) // FINE)).cast("int"))
    slices = sliced.groupBy("pattern", "slice").agg(F.sum("size").alias("n"))
    run = Window.partitionBy("pattern").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    edge = slices.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).join(F.broadcast(q), "pattern").where("before <= part AND part < before + n").select("pattern", F.col("slice").alias("edge"), "before")
    marks = q.join(edge, "pattern", "left").withColumns({"edge": F.coalesce("edge", F.lit(FINE)), "before": F.coalesce("before", F.lit(0))})
    known = sliced.join(F.broadcast(marks), "pattern")  # one row per pattern: at most max_patterns
    extra = ["doc_id", "row_key", "pattern", "size", "kept"]
    below = known.where("slice <> edge").withColumn("taken", F.col("size") * (F.col("whole") + (F.col("slice") < F.col("edge")).cast("int")))
    inside = Window.partitionBy("pattern").orderBy("draw", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    at = known.where("slice = edge").withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at = at.withColumn("taken", F.col("size") * F.col("whole") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("ahead"))))
    cols = [*extra, F.col("taken").cast("long").alias("taken")]
    return below.select(*cols).unionByName(at.select(*cols)), targets, routed


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' targets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got, targets, _ = mix_sources(docs, F.array("source"), keep=("source",))
    got = got.select("doc_id", "size", "taken", F.col("kept.source").alias("source"))
    per = got.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = spark.createDataFrame([(s, float(x)) for s, x in targets.items()], "t_source string, target double")
    side = F.broadcast(per.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("source").alias("s"), "source_size", "target"))  # one row per source, bounded by max_patterns
    return got.join(side, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", "taken")


#: One source per document, so the cheapest flow fills each target in order; targets by water-filling instead of rounds.
SQL4 = r"""
WITH b AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 10) AS BIGINT) AS draw FROM documents),
s AS (SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM b GROUP BY source),
w AS (SELECT source, CAST(n AS DOUBLE) AS n, k, [5, 2, 1][(k - 1) % 3 + 1] AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2 * n / w, k) AS m FROM w),
c AS (SELECT a.m, coalesce(sum(2 * b.n), 0) AS capped, coalesce(sum(b.w), 0) AS gone FROM o a LEFT JOIN o b ON b.m < a.m GROUP BY a.m),
z AS (SELECT 1.5 * sum(n) AS total, sum(w) AS whole FROM o),
l AS (SELECT o.m, (total - capped) / (whole - gone) <= 2 * n / w AS fits, total - capped AS rest, whole - gone AS free FROM o JOIN c ON o.m = c.m, z),
f AS (SELECT min(m) AS m FROM l WHERE fits),
t AS (SELECT source, n, CASE WHEN o.m < coalesce(f.m, 1 << 30) THEN 2 * n ELSE l.rest * w / l.free END AS target FROM o, f LEFT JOIN l ON l.m = f.m),
r AS (SELECT b.*, CAST(n AS BIGINT) AS source_size, target, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole, coalesce(sum(size) OVER (PARTITION BY b.source ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * whole + CASE WHEN source_size > 0 THEN greatest(0, least(size, round_even(target - whole * source_size, 0) - before)) ELSE 0 END AS BIGINT) AS taken
FROM r
"""
