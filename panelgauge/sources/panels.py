"""Panel adapters and outcome codings: the only place where rows are averaged, mapped or recoded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import SpecError


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_annotations(spark: SparkSession, path: str, outcomes: dict[str, str], fmt: str = "csv") -> DataFrame:
    """Annotation rows with the declared columns only; a missing column stops the read before any job."""
    axes = {"item_id": "item", "evaluator": "evaluator", "prompt_type": "prompt", "temperature": "temp", "seed": "seed"}
    if fmt == "csv":
        found = spark.read.option("header", True).csv(path)
    else:
        found = spark.read.format(fmt).load(path)
    lost = [c for c in (*axes, *outcomes) if c not in found.columns]
    if lost:
        raise SpecError(f"columns missing: {lost}")
    return found.select(*[F.col(c).cast("string").alias(n) for c, n in axes.items()], *[F.col(c).cast(k).alias(c) for c, k in outcomes.items()])


def cell_means(rows: DataFrame, axes: list[str], outcomes: dict[str, str]) -> DataFrame:
    """One row per cell: averages outcomes (new name -> column). A deliberate step outside of the operators."""
    return rows.groupBy(*axes).agg(*[F.avg(c).alias(n) for n, c in outcomes.items()])


def price_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brand x flag x status cell means of the retail price, and of the quantity."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return cell_means(li.join(part, li.l_partkey == part.p_partkey), ["p_brand", "l_returnflag", "l_linestatus"], {"price": "p_retailprice", "quantity": "l_quantity"})


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return cell_means(e, ["user_id", "event_type"], {"value": "value"})


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type x hour x dow rows (an incomplete panel on small tables)."""
    return table(spark, sf_dir, "events").select("event_type", F.hour("ts").alias("hour"), F.dayofweek("ts").alias("dow"), "value")


def embedding_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id x hi x lo: one row per component, no averaging."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("d", "v"))
    return e.select("vec_id", F.floor(F.col("d") / 8).cast("int").alias("hi"), (F.col("d") % 8).cast("int").alias("lo"), F.col("v").cast("double").alias("v"))


# ---------------------------------------------------------------- codings


def checked(c: Column, levels: list, what: str) -> Column:
    """c where it is a level; anything else stops the job."""
    return F.when(c.isin(*levels), c).otherwise(F.raise_error(F.concat(F.lit(f"{what}: unknown value "), F.coalesce(c.cast("string"), F.lit("null")))))


def encode_ordinal(c: Column, levels: list[str]) -> Column:
    """1-based code of a declared level, after trimming and upper-casing. An unknown or null label stops the job."""
    names = [x.strip().upper() for x in levels]
    text = checked(F.upper(F.trim(c)), names, "ordinal label")
    return F.array_position(F.array(*map(F.lit, names)), text).cast("int")


def encode_severity(c: Column, top: int) -> Column:
    """A whole number from 1 to ``top``."""
    return checked(c.cast("double"), [float(x) for x in range(1, top + 1)], "severity").cast("int")


def encode_binary(c: Column, yes: list[str] = ("true", "1"), no: list[str] = ("false", "0")) -> Column:
    """1 or 0, after trimming and lower-casing. An unknown or null flag stops the job."""
    text = checked(F.lower(F.trim(c.cast("string"))), [*yes, *no], "flag")
    return text.isin(*yes).cast("int")


def encode_nominal(c: Column, levels: list[str]) -> Column:
    """The label itself. An unknown or null label stops the job."""
    return checked(c, list(levels), "nominal label")


def working_score(c: Column, scores: dict[str, int]) -> Column:
    """The declared score of a label. An unknown or null label stops the job."""
    return F.create_map(*[F.lit(x) for kv in scores.items() for x in kv])[checked(c, list(scores), "scored label")].cast("int")


def any_flag(*flags: Column) -> Column:
    """1 if any flag is set: flags are combined into one group."""
    return reduce(lambda a, b: a | b, [f == 1 for f in flags]).cast("int")


#: The bundled outcome sets, their native family, and how each outcome column is coded.
SCORES7 = {"NORMAL": 1, "STRESS": 2, "ANXIETY": 3, "DEPRESSION": 4, "BIPOLAR": 5, "PERSONALITY DISORDER": 6, "SUICIDAL": 7}
FLAGS = ["depression", "anxiety", "suicidal", "stress", "bipolar", "personality_disorder"]
SCHEMA_VERSION = 1


def _coded(name: str) -> dict[str, Column]:
    """Outcome name -> coded column over the raw annotation columns of an outcome set."""
    flag = lambda c: encode_binary(F.col(c))
    label = F.upper(F.trim(F.col("label")))
    sets = {
        "hate_speech": lambda: {"score": encode_severity(F.col("score"), 3)},
        "drug_review": lambda: {"score": encode_severity(F.col("score"), 5)},
        "drug_review_4aspect": lambda: {c: encode_ordinal(F.col(c), ["NEGATIVE", "NEUTRAL", "POSITIVE"]) for c in ("efficacy", "safety", "burden", "cost")},
        "mental_health_6flag": lambda: {c: flag(c) for c in FLAGS},
        "mental_health_3group": lambda: {"stress": flag("stress"), "anxiety_depression": any_flag(flag("anxiety"), flag("depression")), "bipolar_personality_suicidal": any_flag(flag("bipolar"), flag("personality_disorder"), flag("suicidal"))},
        "mental_health_nominal": lambda: {"label": encode_nominal(label, list(SCORES7))},
        "mental_health_7L": lambda: {"score": working_score(label, SCORES7)},
        "mental_health_3L": lambda: {"score": working_score(label, {k: 1 if v == 1 else 2 if v <= 3 else 3 for k, v in SCORES7.items()})},
    }
    if name not in sets:
        raise SpecError(f"unknown outcome set {name!r}")
    return sets[name]()


def read_example(spark: SparkSession, name: str, path: str, native: bool = False) -> DataFrame:
    """One coded panel of an outcome set: item, evaluator, prompt, temp, seed and its outcomes; a null or unknown value stops it.

    ``native``: a Parquet modelling table with a column schema_version, already coded;
    else the raw annotations as CSV.
    """
    from ..operators.audit import reject_nulls

    axes = {"item_id": "item", "evaluator": "evaluator", "prompt_type": "prompt", "temperature": "temp", "seed": "seed"}
    outcomes = _coded(name)
    if native:
        found = spark.read.parquet(path)
        lost = [c for c in ("schema_version", *axes.values(), *outcomes) if c not in found.columns]
        if lost:
            raise SpecError(f"columns missing: {lost}")
        version = [r[0] for r in found.select("schema_version").distinct().limit(2).collect()]
        if version != [SCHEMA_VERSION]:
            raise SpecError(f"schema version {version} is not {SCHEMA_VERSION}")
        return reject_nulls(found.select(*axes.values(), *outcomes), [*axes.values(), *outcomes])
    found = spark.read.option("header", True).csv(path)
    needed = {c.lower() for c in found.columns}
    lost = [c for c in axes if c not in needed]
    if lost:
        raise SpecError(f"columns missing: {lost}")
    coded = found.select(*[F.col(c).cast("string").alias(n) for c, n in axes.items()], *[c.alias(n) for n, c in outcomes.items()])
    return reject_nulls(coded, [*axes.values(), *outcomes])


def example_catalog(spark: SparkSession) -> DataFrame:
    """name, native_family, outcomes of the bundled outcome sets (schemas only; data are the caller's)."""
    rows = [("hate_speech", "ordinal", 1), ("drug_review", "ordinal", 1), ("drug_review_4aspect", "ordinal", 4), ("mental_health_6flag", "binary", 6), ("mental_health_3group", "binary", 3), ("mental_health_nominal", "categorical", 1), ("mental_health_7L", "gaussian", 1), ("mental_health_3L", "gaussian", 1)]
    return spark.createDataFrame(rows, T._parse_datatype_string("name string, native_family string, outcomes int"))
