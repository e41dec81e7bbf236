"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op10_ann, op10_sql
from .bpe import op4_bpe
from .chat import op5_chat, op5_sql
from .dedup import op1_near_dedup, op1_sql
from .licenses import op6_licenses
from .packing import op7_packing
from .ppm import op9_lm_score
from .quality import op2_quality
from .toxicity import op3_toxicity
from .urls import op8_sql, op8_urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_quality": op2_quality,
        "op3_toxicity": op3_toxicity,
        "op4_bpe": op4_bpe,
        "op5_chat": op5_chat,
        "op6_licenses": op6_licenses,
        "op7_packing": op7_packing,
        "op8_urls": op8_urls,
        "op9_lm_score": op9_lm_score,
        "op10_ann": op10_ann,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": op1_sql(), "op5_chat": op5_sql(), "op8_urls": op8_sql(), "op10_ann": op10_sql()}
