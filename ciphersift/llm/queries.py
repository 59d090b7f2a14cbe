"""Registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ciphersift.llm import chat_format, jaccard_join, topk
from ciphersift.llm.attention_lm import op10_lm_scoring
from ciphersift.llm.chat_format import op4_chat_formatting
from ciphersift.llm.cotrain import op5_quality
from ciphersift.llm.decontam import op2_decontamination
from ciphersift.llm.html_extract import op3_html_extraction
from ciphersift.llm.jaccard_join import op12_jaccard_join
from ciphersift.llm.segmentation import op1_segmentation
from ciphersift.llm.simhash import op6_simhash
from ciphersift.llm.spelling import op13_spelling_variants
from ciphersift.llm.token_alignment import op11_token_alignment
from ciphersift.llm.token_counts import op9_token_counts
from ciphersift.llm.topk import op8_top_k
from ciphersift.llm.toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_segmentation": op1_segmentation,
    "op2_decontamination": op2_decontamination,
    "op3_html_extraction": op3_html_extraction,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_top_k": op8_top_k,
    "op9_token_counts": op9_token_counts,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_token_alignment": op11_token_alignment,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat_formatting": chat_format.ORACLE_SQL,
    "op8_top_k": topk.ORACLE_SQL,
    "op12_jaccard_join": jaccard_join.ORACLE_SQL,
}
