"""N-gram Jaccard join with prefix filters under several global token orders.

A document's set holds the hashes of its distinct k-word shingles. Two documents
with |A n B| / |A u B| >= t share, under *any* total order of the tokens, at
least one of the first |A| - ceil(t |A|) + 1 tokens of each. The orders used here
rank rare tokens first and break ties by differently seeded hashes, so a
candidate pair must share a prefix token under every one of them.

1. A fixed-size sketch counts shingles over all documents (bounded, broadcast)
   and gives each token a rarity level; levels only shape the orders, never the result.
2. Prefix tokens of the first order, with tokens of one document dropped. Documents
   with equal sets are one (the least row stands for them). Documents that share a token are compared by the histograms of their sets: the L1 distance
   of two histograms never exceeds the symmetric difference, so a pair whose distance
   is too large for a link is none. A run of documents leaves a spanning forest of
   what is left, never its pairs; the components hold every linked pair inside one.
3. Components above ``block`` sets are split into blocks, one task group for each
   pair of blocks. A group intersects the candidates of all orders through inverted
   lists, verifies them exactly and returns a spanning forest of its links.
4. Connected components of the forest edges give the classes.

Defined results
  null or empty text, no words   an empty set, linked with nothing, its own component
  fewer than k words             the whole sequence is the one shingle
  null id                        ranks after all others; its component is the least non-null id reached, else null
  repeated rows                  equal texts link; each row has its own result
  empty table                    no rows
  very long text                 its whole set, in one row of its blocks
  other columns                  ignored by the join, passed through by drop_near_duplicates, whatever their names
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, gram_hashes, mix, release, release_caches, tidy, word_hashes, write_cut

SKETCH_LOG2 = 20
SEGMENTS = 64
ORDERS = 3
_edges = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes; A-Z are lowered."""
    return np.unique(gram_hashes(word_hashes(text, lower=True), k))


def order_keys(tokens: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """Places of the tokens in the given global order: rarity level first, then a seeded hash."""
    level = levels[(tokens >> np.uint64(64 - SKETCH_LOG2)).astype(np.int64)].astype(np.uint64)
    return (level << np.uint64(58)) | (mix(tokens, 100 + order) >> np.uint64(6))


def prefix(keys: np.ndarray, percent: int) -> np.ndarray:
    """The first |A| - ceil(t |A|) + 1 keys of the order."""
    n = len(keys)
    if not n:
        return keys
    size = n - -(-percent * n // 100) + 1
    return np.sort(keys) if size >= n else np.sort(np.partition(keys, size - 1)[:size])


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        counts = np.zeros(1 << SKETCH_LOG2, np.int64)
        held, n = [], 0
        shift = np.uint64(64 - SKETCH_LOG2)
        for b in batches:
            for t in b.column(0).to_pylist():
                s = shingles(t, k)
                held.append(s >> shift)
                n += len(s)
                if n > 1_000_000:
                    counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts))
                    held, n = [], 0
        if held:
            counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts))
        parts = np.minimum(counts, 2**32 - 1).astype("<u4").reshape(SEGMENTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["segment", "counts"])

    return run


def _sum_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the segments of a partition as they stream by: memory of at most one sketch."""
    totals: dict[int, np.ndarray] = {}
    for b in batches:
        for segment, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            part = np.frombuffer(counts.as_buffer(), "<u4")
            if segment in totals:
                totals[segment] += part
            else:
                totals[segment] = part.astype(np.int64)
    if totals:
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([np.minimum(t, 2**32 - 1).astype("<u4").tobytes() for t in totals.values()], pa.binary())], names=["segment", "counts"])


def rarity_levels(texts: DataFrame, k: int) -> np.ndarray:
    """A level (0 to 31) for each cell of the sketch: doublings above twice the mean load. The table has a fixed size."""
    ddl = "segment int, counts binary"
    parts = texts.mapInArrow(tidy(_sketch(k)), ddl)
    # two steps, so that no task reads the sketches of all others: about the square root of their number each
    fan = max(1, round(parts.rdd.getNumPartitions() ** 0.5))
    salted = parts.withColumn("salt", F.spark_partition_id() % fan)
    some = salted.repartition(8 * fan, "segment", "salt").select("segment", "counts").mapInArrow(_sum_segments, ddl)
    rows = some.repartition(8, "segment").mapInArrow(_sum_segments, ddl).collect()  # about SEGMENTS rows, 4 MB in all
    counts = np.zeros((SEGMENTS, (1 << SKETCH_LOG2) // SEGMENTS))
    for r in rows:
        counts[r["segment"]] += np.frombuffer(r["counts"], "<u4")
    counts = counts.ravel()
    base = counts.mean() + 4 * np.sqrt(counts.mean()) + 2
    return np.clip(np.ceil(np.log2(np.maximum(counts, 1) / base)) * 2, 0, 31).astype(np.uint8)


HIST = 64  # least number of histogram bins; a set of n tokens has the power of two from n / 8 on
_doc_ddl = "row_id long, doc_id long, text_hash long, n long, fp1 long, fp2 long, tokens array<long>, hist binary"


def histogram(s: np.ndarray) -> bytes:
    """Counts of the tokens by their low bits, at most 255 each; a longer one folds onto a shorter one by adding its halves."""
    bins = max(HIST, 1 << max(0, (len(s) // 8 - 1).bit_length()))
    return np.minimum(np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def _documents(levels: np.ndarray, k: int, percent: int):
    """Per document: size and fingerprint of its set, and its prefix tokens under the first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            ns, f1, f2, toks, hists = [], [], [], [], []
            for t in b.column(3).to_pylist():
                s = shingles(t, k)
                ns.append(len(s))
                with np.errstate(over="ignore"):
                    f1.append(int(mix(s, 77).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    f2.append(int(mix(s, 78).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                toks.append(prefix(order_keys(s, levels, 0), percent).view(np.int64))
                hists.append(histogram(s))
            ends = np.cumsum([0, *map(len, toks)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(toks) if toks else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(x, pa.int64()) for x in (ns, f1, f2)], tokens, pa.array(hists, pa.binary())], names=["row_id", "doc_id", "text_hash", "n", "fp1", "fp2", "tokens", "hist"])

    return run


def near_forest(n: np.ndarray, hists: list[bytes], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose histograms leave a link possible.

    What the middle row reaches is one tree; every other row is compared with all
    rows. Sizes that may link differ by less than a doubling, so only histograms of
    the same or a neighbouring length are compared, the longer one folded.
    """
    label = np.arange(len(n))
    size = np.array([len(h) for h in hists])
    at = {b: np.flatnonzero(size == b) for b in np.unique(size).tolist()}
    table = {b: np.frombuffer(b"".join(hists[i] for i in rows), np.uint8).reshape(-1, b).astype(np.int32) for b, rows in at.items()}
    folded = {b: t[:, : b // 2] + t[:, b // 2 :] for b, t in table.items() if b // 2 in at}
    out = []

    def near(i: int) -> np.ndarray:
        b = int(size[i])
        own = np.frombuffer(hists[i], np.uint8).astype(np.int32)
        found = []
        for rows, t, mine in ((at.get(b), table.get(b), own), (at.get(2 * b), folded.get(2 * b), own), (at.get(b // 2), table.get(b // 2), own[: b // 2] + own[b // 2 :])):
            if rows is None:
                continue
            rough = np.flatnonzero(100 * np.minimum(n[rows], n[i]) >= percent * np.maximum(n[rows], n[i]))
            for k in range(0, len(rough), 4096):
                some = rough[k : k + 4096]
                away = np.abs(t[some] - mine).sum(1)
                found.append(rows[some[away * (100 + percent) <= (n[rows[some]] + n[i]) * (100 - percent)]])
        return np.concatenate(found)

    def join(i: int) -> None:
        for j in near(i):
            if label[j] != label[i]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]

    middle = int(np.argsort(n, kind="stable")[len(n) // 2])
    tree = near(middle)
    tree = tree[tree != middle]
    out += [(middle, int(j)) for j in tree]
    label[tree] = label[middle]
    for i in np.flatnonzero(label != label[middle]):
        join(int(i))
    return out


def _forests(percent: int):
    """Rows sorted by token: the forest of each run of rows of one token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        u, v, seen = [], [], set()

        def close() -> None:
            if len(held) > 1:
                n = np.array([h[1] for h in held], np.int64)
                for a, b in near_forest(n, [h[2] for h in held], percent):
                    x, y = held[a][0], held[b][0]
                    e = (x, y) if x > y else (y, x)
                    if e not in seen:
                        seen.add(e)
                        u.append(e[0])
                        v.append(e[1])
            held.clear()

        token = None
        for b in batches:
            for t, r, n, h in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if t != token:
                    close()
                    token = t
                held.append((r, n, h))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_edges)
                u.clear(), v.clear()
            if len(seen) > 200_000:
                seen.clear()
        close()
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_edges)

    return run


def linked_pairs(sets: list[np.ndarray], percent: int, levels: np.ndarray, left: np.ndarray | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between the given sets: candidates share a prefix token under every order.

    With ``left`` (marks of one block) only pairs across the blocks are looked at.
    A candidate that is already connected is not verified again.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    pools = []
    for order in range(ORDERS):
        pre = [prefix(order_keys(s, levels, order), percent) for s in sets]
        flat = np.concatenate(pre)
        own = np.repeat(np.arange(n), [len(p) for p in pre])
        at = np.argsort(flat, kind="stable")
        flat, own = flat[at], own[at]
        ids = np.concatenate(([0], np.cumsum(flat[1:] != flat[:-1])))
        starts = np.concatenate((np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))), [len(flat)]))
        back = np.argsort(own, kind="stable")
        doc_starts = np.concatenate(([0], np.cumsum([len(p) for p in pre])))
        pools.append((own, starts, ids[back], doc_starts))
    whole = np.concatenate(sets)
    w_own = np.repeat(np.arange(n), sizes)
    at = np.argsort(whole, kind="stable")
    whole, w_own = whole[at], w_own[at]
    first = np.concatenate(([True], whole[1:] != whole[:-1]))
    w_ids = np.cumsum(first) - 1
    w_starts = np.concatenate((np.flatnonzero(first), [len(whole)]))
    w_back = w_ids[np.argsort(w_own, kind="stable")]
    w_doc = np.concatenate(([0], np.cumsum(sizes)))
    label = np.arange(n) if label is None else label
    out = []
    for i in range(n):
        near = None
        for own, starts, ids, doc_starts in pools:
            mine = ids[doc_starts[i] : doc_starts[i + 1]]
            mine = mine[starts[mine + 1] - starts[mine] > 1]
            if not len(mine):
                near = None
                break
            hit = np.zeros(n, bool)
            for g in mine:
                hit[own[starts[g] : starts[g + 1]]] = True
            near = hit if near is None else near & hit
        if near is None:
            continue
        near[: i + 1] = False
        near &= (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])) & (label != label[i])
        if left is not None:
            near &= left != left[i]
        cand = np.flatnonzero(near)
        if not len(cand):
            continue
        if len(cand) > 8:  # overlap with all candidates at once, through the inverted lists
            mine = w_back[w_doc[i] : w_doc[i + 1]]
            mine = mine[w_starts[mine + 1] - w_starts[mine] > 1]
            both = np.bincount(np.concatenate([w_own[w_starts[g] : w_starts[g + 1]] for g in mine]), minlength=n)[cand]
        else:
            both = np.array([np.isin(sets[i], sets[j], assume_unique=True).sum() for j in cand])
        good = cand[100 * both >= percent * (sizes[i] + sizes[cand] - both)]
        for j in good:
            if label[j] != label[i]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    return out


def _verify(k: int, percent: int, levels: np.ndarray):
    def run(group: pa.Table) -> pa.Table:
        release_caches()
        group = group.sort_by([("class", "ascending"), ("i", "ascending"), ("j", "ascending"), ("rep", "ascending")])
        keys = group.column("rep").to_numpy()
        cols = [group.column(c).to_numpy() for c in ("class", "i", "j")]
        side, texts = group.column("side").to_numpy(), group.column("text")
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        u, v = [], []
        for s, e in zip(np.r_[0, edge], np.r_[edge, len(keys)], strict=True):
            at = [x for x in range(s, e) if x == s or keys[x] != keys[x - 1]]  # a repeated input row comes twice
            if len(at) < 2:
                continue
            sets = [shingles(texts[x].as_py(), k) for x in at]
            left = None if cols[1][s] == cols[2][s] else side[at]
            for a, b in linked_pairs(sets, percent, levels, left):
                u.append(int(keys[at[b]]))
                v.append(int(keys[at[a]]))
        return pa.Table.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_edges)

    return run


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = 1024) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id for every row: classes of the links at ``percent`` / 100 on k-word shingles.

    component_id is the least doc_id that links reach.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be between 50 and 100")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    levels = rarity_levels(base.select("text"), k)
    found = base.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text_hash", "text").mapInArrow(tidy(_documents(levels, k, percent)), _doc_ddl)
    found = write_cut(found, "prefix")
    reps = write_cut(found.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("row_id").alias("rep")), "reps")
    rows = write_cut(found.drop("tokens", "hist").join(reps, ["fp1", "fp2", "n"], "left").select("row_id", "doc_id", "text_hash", "n", "rep"), "rows")
    firsts = rows.where("row_id = rep")
    each = Window.partitionBy("token")
    shared = found.select(F.explode("tokens").alias("token"), "row_id").withColumn("alone", F.min("row_id").over(each) == F.max("row_id").over(each)).where("NOT alone").select("token", "row_id")
    # of documents with equal sets only the first is compared; its histogram travels once to the join by row
    one_each = found.select("row_id", "n", "hist").join(reps.select(F.col("rep").alias("row_id")), "row_id", "left_semi")
    compared = shared.join(one_each, "row_id").select("token", "row_id", "n", "hist")
    forests = compared.repartition("token").sortWithinPartitions("token", "row_id").mapInArrow(tidy(_forests(percent)), "u long, v long")
    edges = write_cut(connected_components(forests, "rough-cc").select(F.col("node").alias("rep"), F.col("component").alias("class")), "rough")
    rough = edges.join(firsts.select("rep", "doc_id", "text_hash", "n"), "rep")
    # a block holds about so many sets, and about 600 shingles for each of them
    size = F.greatest(F.count("*") / block, F.sum("n") / (600 * block))
    crowd = rough.groupBy("class").agg(F.count("*").alias("m"), F.ceil(size).cast("int").alias("nb")).where("m > 1").select("class", "nb")
    placed = rough.join(crowd, "class").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    texts = base.join(placed, base.doc_id.eqNullSafe(placed.doc_id) & (base.text_hash == placed.text_hash)).select("rep", "class", "nb", "own", "text")
    pair = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j"), (x < F.col("own")).cast("int").alias("side")))
    dealt = texts.select("rep", "class", "text", F.explode(pair).alias("p")).select("rep", "class", "text", "p.i", "p.j", "p.side")
    groups = max(8, rough.count() // 256)
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("class", "i", "j"), F.lit(groups)))
    links = write_cut(dealt.groupBy("g").applyInArrow(_verify(k, percent, levels), "u long, v long"), "links")
    release(found, edges)
    parts = connected_components(links, "jaccard-cc").select(F.col("node").alias("rep"), "component")
    member = write_cut(rows.join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "members")
    release(links, rows, reps)
    # written, so that the join below has plain exchanges on both sides and a hot component can be split
    least = write_cut(member.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    out = member.join(least, "component", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each class the rows with the least doc_id stay (once, if repeated)."""
    found = jaccard_classes(docs, k, percent, id_col, text_col)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stay_id"), F.col("text_hash").alias("stay_hash")).distinct()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("hash"), F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row"))
    kept = rows.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("hash") == F.col("stay_hash")))
    # rows that repeat id and text: one stays
    return kept.dropDuplicates(["id", "hash"]).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents at Jaccard 0.9 over three-word shingles."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90).select("doc_id", "n_shingles", "component_id")


#: All pairs that share a shingle.
SQL2 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                          ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
l AS (SELECT x AS u, y AS v FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.v FROM r JOIN l ON r.reach = l.u)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach) AS component_id
FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""
