"""Corpus pipeline: quality rules, line dedup, near-duplicate join, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir); ``run`` writes every stage's result as
Parquet in the shared folder and reads it as the next one's docs.

Defined results of all stages
  null or empty text   rejected by the quality rules; later stages given one keep it as it is (packing: the end id alone)
  null id              ranks after all others
  repeated rows        judged alike by the rules; line dedup gives them one result, the near-duplicate join keeps one
  very long text       whole texts everywhere
  empty table          no rows
  other columns        passed through up to the mix, whatever their names; packing returns pieces only
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgauge.llm.common import write_cut
from panelgauge.llm.jaccard_join import drop_near_duplicates
from panelgauge.llm.line_dedup import drop_repeated_lines
from panelgauge.llm.mixing import take_copies
from panelgauge.llm.packing import pack
from panelgauge.llm.quality import filter_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts; n_chars follows the text."""
    return drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: five words, similarity 0.8 or more."""
    return drop_near_duplicates(docs, 5, 80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole copies, at most two; the document at a boundary is rounded."""
    return take_copies(docs, F.array("source"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of at most 2048 tokens."""
    return pack(docs, cache_parts=300_000, keep_cache=False)  # the stages share the executors' memory


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("source mixing", source_mixing), ("packing", packing)]

#: The log-likelihood ratio and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all packed documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
