"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from latticebits.llm import audit, decontaminate, lloyd, minhash, sharding, suffixes, topk, windows
from latticebits.llm.audit import op13_filter_audit
from latticebits.llm.decontaminate import op6_decontamination
from latticebits.llm.language import op1_language
from latticebits.llm.lloyd import op11_vector_codes
from latticebits.llm.minhash import op10_near_duplicates
from latticebits.llm.packing import op5_packing
from latticebits.llm.pii import op7_pii
from latticebits.llm.prefix_counts import op12_token_counts
from latticebits.llm.sharding import op4_sharding
from latticebits.llm.suffixes import op3_suffix_dedup
from latticebits.llm.token_output import op8_token_output
from latticebits.llm.topk import op2_topk
from latticebits.llm.windows import op9_window_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_language, op2_topk, op3_suffix_dedup, op4_sharding, op5_packing, op6_decontamination, op7_pii, op8_token_output, op9_window_dedup, op10_near_duplicates, op11_vector_codes, op12_token_counts, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_topk": topk.ORACLE_SQL,
        "op3_suffix_dedup": suffixes.ORACLE_SQL,
        "op4_sharding": sharding.ORACLE_SQL,
        "op6_decontamination": decontaminate.ORACLE_SQL,
        "op9_window_dedup": windows.ORACLE_SQL,
        "op10_near_duplicates": minhash.ORACLE_SQL,
        "op11_vector_codes": lloyd.ORACLE_SQL,
        "op13_filter_audit": audit.ORACLE_SQL,
    }
