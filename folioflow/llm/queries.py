"""The training-data queries: one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .chat import OP7_SQL, op7_chat_format
from .decontaminate import op9_decontamination
from .packing import op4_packing
from .quality import op8_quality_rules
from .secret_scan import op6_secret_scan
from .sharding import op10_sharding
from .simhash import op3_simhash
from .substring_dedup import op2_substring_dedup
from .suffix_dedup import op5_suffix_dedup
from .token_output import op1_token_output


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_output": op1_token_output,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_simhash": op3_simhash,
        "op4_packing": op4_packing,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_secret_scan": op6_secret_scan,
        "op7_chat_format": op7_chat_format,
        "op8_quality_rules": op8_quality_rules,
        "op9_decontamination": op9_decontamination,
        "op10_sharding": op10_sharding,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """SQL can express the chat format; the others are held against brute force in ``tests/llm``."""
    found = {"op7_chat_format": OP7_SQL}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
