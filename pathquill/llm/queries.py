"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_codec import op9_bpe_codec
from .decontamination import op5_decontamination
from .embedding_dedup import op1_embedding_near_dedup
from .language_model import op6_lm_scoring
from .licenses import op8_license_scan
from .minhash_dedup import op2_minhash_near_dedup
from .oracles import ORACLE_SQL
from .substring_dedup import op4_substring_dedup
from .suffix_dedup import op10_suffix_dedup
from .token_counts import op7_token_counts
from .toxicity import op3_toxicity

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_token_counts": op7_token_counts,
    "op8_license_scan": op8_license_scan,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_suffix_dedup": op10_suffix_dedup,
}
