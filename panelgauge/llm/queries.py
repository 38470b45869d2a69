"""The queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embedding_dedup import SQL8, op8_embedding_dedup
from .html_extract import op7_html_extract
from .jaccard_join import SQL2, op2_jaccard_join
from .line_dedup import SQL10, op10_line_dedup
from .mixing import SQL4, op4_mixing
from .packing import op5_packing
from .quality import op3_quality
from .suffix_dedup import SQL1, op1_suffix_dedup
from .token_store import op6_token_store
from .warc import SQL9, op9_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_quality": op3_quality,
        "op4_mixing": op4_mixing,
        "op5_packing": op5_packing,
        "op6_token_store": op6_token_store,
        "op7_html_extract": op7_html_extract,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_warc": op9_warc,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": SQL1, "op2_jaccard_join": SQL2, "op4_mixing": SQL4, "op8_embedding_dedup": SQL8, "op9_warc": SQL9, "op10_line_dedup": SQL10}
