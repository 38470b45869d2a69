"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling, in DataFrame operations only.

Every document is a sequence of line ids (lines with a word; other lines are left
alone). Documents of equal text are one sequence, that of the least id.

1. Suffixes are ranked by their first line, then by their first 2, 4, 8, ... lines: a
   doubling step joins the rank of a suffix with the rank of the suffix that many
   lines on and ranks the pairs. Ranks ascend with the sorted order of the distinct
   pairs (range partitions, and the place in each), so a step sorts distinct pairs,
   never one key's rows in one task. A suffix that is alone in its rank has no repeat
   of that depth and leaves; doubling ends when all have left.
2. The suffixes that agree on d lines form an interval of the suffix array with a
   longest common prefix of at least d. With 2^k <= d < 2^(k+1) its members have equal
   ranks at depth 2^k both at their start and d - 2^k lines on, so an interval of any
   depth is a pair of ranks. For each suffix the deepest interval in which another
   place comes first gives the length of the longest run from there that has an
   earlier copy: read off where one source explains all, else found by bisection over d.
3. A run that reaches further than the run one line before it is a maximal repeat.
   Maximal repeats of at least ``min_lines`` lines, or of at least ``min_words`` words,
   are deleted; the first place of a run always stays.

Defined results
  null text            one empty line
  null id              ranks after all others
  equal texts          the least id stays; the others are one run from start to end
  repeated rows        rows equal in id and text are one occurrence and share its result
  ties                 equal ids with other texts are ordered by a hash of the text
  overlapping copies   within a document, too, the first occurrence stays
  very long text       as many suffixes as lines, never a row that grows with the corpus
  empty table          no rows
  other columns        passed through by drop_repeated_lines in one struct, whatever their names
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, release, scratch_path, write_cut

LAST_ID = (1 << 63) - 1
DOC = ["doc", "text_hash"]
TEXT = ["text_hash", "text_hash2"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _place() -> Column:
    return F.struct(*DOC, "q")


def _identity(text: Column) -> list[Column]:
    """Two hashes that stand for the whole text."""
    return [F.xxhash64(text).alias("text_hash"), F.xxhash64(F.lit(1), text).alias("text_hash2")]


def ranked(keys: DataFrame, by: list[str]) -> DataFrame:
    """keys with ``rank``, which ascends with the (distinct) values ``by``: range partitions in order, and the row's number in its sorted partition."""
    return keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())


def repeated(suffixes: DataFrame, by: list[str]) -> DataFrame:
    """The suffixes whose values ``by`` stand at two places or more, with their rank and the first place."""
    groups = suffixes.groupBy(*by).agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("first <> last").drop("last")
    return suffixes.join(ranked(groups, by), by).drop(*by)


def sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct text: its identity, least id, and its lines with a word (place among all lines, words, line id)."""
    text = F.col(f"`{text_col}`").cast("string")
    base = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("doc"), *_identity(text), _lines(text).alias("lines"))
    each = F.transform("lines", lambda x, i: F.struct(i.alias("pos"), F.regexp_count(x, F.lit(WORD_PATTERN)).alias("words"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2")))
    found = base.select("doc", *TEXT, F.filter(each, lambda x: x["words"] > 0).alias("lines"))
    return found.groupBy(*TEXT).agg(F.min("doc").alias("doc"), F.first("lines").alias("lines"))


_level_ddl = "doc long, text_hash long, q int, pos int, words int, rank long, first struct<doc: long, text_hash: long, q: int>"


def suffix_levels(seqs: DataFrame) -> tuple[DataFrame, int]:
    """All levels (column k) and their number. Level k: every suffix whose first 2**k lines stand at another place, too, with its rank at that depth and the first place."""
    spark = seqs.sparkSession
    path = scratch_path(spark, "levels")

    def save(k: int, df: DataFrame) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{path}/k={k}")
        return spark.read.schema(_level_ddl).parquet(f"{path}/k={k}")

    suffixes = seqs.select(*DOC, F.posexplode("lines").alias("q", "line")).select(*DOC, "q", "line.pos", "line.words", "line.h1", "line.h2")
    now, k = save(0, repeated(suffixes, ["h1", "h2"])), 0
    while not now.isEmpty():
        ahead = now.select(*DOC, (F.col("q") - (1 << k)).alias("q"), F.col("rank").alias("next"))
        k += 1
        now = save(k, repeated(now.select(*DOC, "q", F.col("rank").alias("head")).join(ahead, [*DOC, "q"]), ["head", "next"]))
    levels = spark.read.schema(f"{_level_ddl}, k int").parquet(path)
    levels._scratch_path = path
    return levels, k


def _first_guess(levels: DataFrame) -> DataFrame:
    """Per suffix with an earlier copy its deepest level and rank, and two bounds of where its run ends.

    ``reach``: neighbouring suffixes of one level whose first places neighbour, too, copy one source up to there; so do those
    whose last places before them in their own document neighbour.
    ``upper``: no run crosses two lines that have no earlier copy.
    """
    source = F.struct(F.col("first.doc").alias("doc"), F.col("first.text_hash").alias("text_hash"), (F.col("first.q") - F.col("q")).alias("away"))
    own = F.lag("q").over(Window.partitionBy("k", *DOC, "rank").orderBy("q")) - F.col("q")
    # all windows are over the lines of one document and need no other exchange
    every = levels.repartition(*DOC).select("k", *DOC, "q", "rank", "first", own.alias("own"))
    later = every.where(F.col("first") < _place()).select("k", *DOC, "q", "rank", "own", source.alias("source"))
    island = lambda *by: F.col("q") - F.row_number().over(Window.partitionBy("k", *DOC, *by).orderBy("q"))
    last = lambda *by: F.max("q").over(Window.partitionBy("k", *DOC, *by))
    both = later.withColumns({"run": island("source"), "own_run": island("own"), "pair": island()})
    both = both.withColumns({"reach": last("source", "run"), "own_reach": F.when(F.col("own").isNotNull(), last("own", "own_run")), "upper": last("pair")})
    reach = F.max(F.greatest("reach", "own_reach") + F.expr("shiftleft(1, k)"))
    found = both.groupBy(*DOC, "q").agg(F.max(F.struct("k", "rank")).alias("top"), reach.alias("reach"), F.max(F.when(F.col("k") == 1, F.col("upper") + 2)).alias("upper"))
    return found.select(*DOC, "q", "top.k", "top.rank", "reach", F.coalesce("upper", F.col("q") + 1).alias("upper"))


def longest_earlier(levels: DataFrame, n: int) -> DataFrame:
    """doc, text_hash, q, run: the most lines from there on that also stand at an earlier place; for suffixes with any.

    Where the two bounds of the first guess differ, the depth is found by bisection over intervals.
    """
    guess = write_cut(_first_guess(levels), "guess")
    settled = guess.where("reach = upper").select(*DOC, "q", (F.col("reach") - F.col("q")).alias("run"))
    best = guess.where("reach < upper").select(*DOC, "q", "k", "rank", F.lit(0).alias("on"))
    open_ones = best.agg(F.max("k")).first()[0]
    steps = 0 if open_ones is None else open_ones
    done = [guess]
    for j in range(steps - 1, -1, -1):  # the depth is 2**k + on; try 2**j lines more
        deep = levels.where((F.col("k") > j) & (F.col("k") <= steps))
        asked = best.where(F.col("k") > j).select("k", "rank", (F.col("on") + (1 << j)).alias("on")).distinct()
        member = deep.select("k", *DOC, "q", "rank").join(asked, ["k", "rank"]).withColumn("at", F.col("q") + F.col("on"))
        there = deep.select("k", *DOC, F.col("q").alias("at"), F.col("rank").alias("next"))
        interval = ["k", "rank", "on", "next"]
        found = write_cut(member.join(there, ["k", *DOC, "at"]).select(*DOC, "q", *interval), "members")
        firsts = write_cut(found.groupBy(*interval).agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("first <> last").drop("last"), "intervals")
        longer = found.join(firsts, interval).where(F.col("first") < _place()).select(*DOC, "q", "k", (F.col("on") - (1 << j)).alias("on"), F.lit(1 << j).alias("more"))
        best = write_cut(best.join(longer, [*DOC, "q", "k", "on"], "left").select(*DOC, "q", "k", "rank", (F.col("on") + F.coalesce("more", F.lit(0))).alias("on")), "best")
        release(found, firsts)
        done.append(best)
    out = write_cut(settled.unionByName(best.select(*DOC, "q", (F.expr("shiftleft(1, k)") + F.col("on")).alias("run"))), "longest")
    release(*done)
    return out


def repeated_runs(seqs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """doc, text_hash, runs (lines to delete as (first, end) places among all lines), n_runs (maximal repeats deleted)."""
    levels, n = suffix_levels(seqs)
    longest = longest_earlier(levels, n)
    lines = levels.where("k = 0").select(*DOC, "q", "pos", "words").join(longest, [*DOC, "q"], "left")
    order = Window.partitionBy(*DOC).orderBy("q")  # the lines of one document
    end = F.col("q") + F.col("run")
    before = F.when(F.lag("q").over(order) == F.col("q") - 1, F.lag(end).over(order))
    words = sum((F.when(F.col("run") > i, F.coalesce(F.lead("words", i).over(order), F.lit(0))).otherwise(0) for i in range(min_lines - 1)), F.lit(0))
    maximal = F.col("run").isNotNull() & (before.isNull() | (end > before))
    ok = maximal & ((F.col("run") >= min_lines) | (words >= min_words))
    marked = lines.withColumns({"ok": ok, "end": end})
    reach = F.max(F.when(F.col("ok"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    gone = marked.withColumn("reach", reach).where("reach > q")
    gone = gone.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy(*DOC).orderBy("pos")))
    runs = gone.groupBy(*DOC, "island").agg(F.min("pos").alias("first"), (F.max("pos") + 1).alias("end"), F.sum(F.col("ok").cast("long")).alias("n_runs"))
    out = write_cut(runs.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("runs"), F.sum("n_runs").alias("n_runs")), "runs")
    release(levels, longest)
    return out


def _marked(docs: DataFrame, min_lines: int, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """row (a struct of the columns of docs), text, lines, kept (the lines that stay, null if all do) and n_runs."""
    seqs = write_cut(sequences(docs, id_col, text_col), "sequences")
    runs = repeated_runs(seqs, min_lines, min_words)
    words = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    whole = (F.size("lines") > 0) & ((F.size("lines") >= min_lines) | (words >= min_words))  # a later copy is one run from start to end
    known = seqs.join(runs, DOC, "left").select(*TEXT, F.col("doc").alias("owner"), whole.alias("whole"), "runs", "n_runs").where("whole OR runs IS NOT NULL")
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("doc"), text.alias("text"), *_identity(text))
    both = rows.join(known, TEXT, "left").withColumn("lines", _lines(F.col("text")))
    copy = F.coalesce(F.col("whole") & (F.col("doc") > F.col("owner")), F.lit(False))
    n = F.size("runs")
    between = F.transform(F.sequence(F.lit(0), n), lambda j: F.struct(F.when(j == 0, 0).otherwise(F.get("runs", j - 1)["end"]).alias("a"), F.when(j == n, F.size("lines")).otherwise(F.get("runs", j)["first"]).alias("b")))
    rest = F.flatten(F.transform(between, lambda r: F.slice("lines", r["a"] + 1, r["b"] - r["a"])))
    blank = F.filter("lines", lambda x: F.regexp_count(x, F.lit(WORD_PATTERN)) == 0)
    kept = F.when(copy, blank).when((F.col("doc") == F.col("owner")) & F.col("runs").isNotNull(), rest)
    runs_of = F.when(copy, F.lit(1)).when(F.col("doc") == F.col("owner"), F.col("n_runs"))
    return both.select("row", "text", "lines", kept.alias("kept"), F.coalesce(runs_of, F.lit(0)).cast("long").alias("n_runs"))


def drop_repeated_lines(docs: DataFrame, min_lines: int = 2, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the later copies of maximal repeated line runs deleted; texts without any stay as they are, null too."""
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    return _marked(docs, min_lines, min_words, id_col, text_col).select(*[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: lines, deleted lines and maximal repeats, and a digest of what stays."""
    got = _marked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 2, 50, "doc_id", "text")
    kept = F.coalesce("kept", "lines")
    return got.select(
        "row.doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(kept)).cast("long").alias("n_removed"),
        "n_runs",
        F.md5(F.array_join(kept, "\n")).alias("kept_md5"),
    )


#: By diagonals instead of suffixes: equal lines of two places, joined to runs along their distance.
SQL10 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
s AS (
  SELECT doc_id, pos, line, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS q,
         sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS ws
  FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l) WHERE w > 0),
p AS (
  SELECT a.doc_id AS da, b.doc_id AS db, b.q - a.q AS away, b.q,
         b.q - row_number() OVER (PARTITION BY a.doc_id, b.doc_id, b.q - a.q ORDER BY b.q) AS island
  FROM s a JOIN s b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.q < b.q))),
d AS (SELECT DISTINCT db AS doc_id, first, past FROM (SELECT da, db, away, island, min(q) AS first, max(q) + 1 AS past FROM p GROUP BY ALL)),
m AS (
  SELECT doc_id, first, past FROM d
  QUALIFY coalesce(max(past) OVER (PARTITION BY doc_id ORDER BY first, past DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < past),
r AS (
  SELECT m.* FROM m JOIN s a ON a.doc_id = m.doc_id AND a.q = m.first JOIN s b ON b.doc_id = m.doc_id AND b.q = m.past - 1
  WHERE m.past - m.first >= 2 OR b.ws - a.ws + a.w >= 50),
g AS (SELECT DISTINCT s.doc_id, s.pos FROM s JOIN r ON s.doc_id = r.doc_id AND s.q >= r.first AND s.q < r.past),
c AS (SELECT doc_id, count(*) AS n_runs FROM r GROUP BY doc_id),
a AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_md5
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT a.doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed,
       CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, kept_md5
FROM a LEFT JOIN c ON a.doc_id = c.doc_id
"""
