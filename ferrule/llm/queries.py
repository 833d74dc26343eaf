"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferrule.llm.chain_dedup import op5_chain_dedup
from ferrule.llm.decontaminate import OP8_SQL, op8_decontamination
from ferrule.llm.html_text import op4_html_text
from ferrule.llm.mixing import op3_mixing
from ferrule.llm.ngram_join import OP1_SQL, op1_ngram_join
from ferrule.llm.quality import BASE_SQL, base_quality_counts, op6_quality_rules
from ferrule.llm.secrets import op7_secrets
from ferrule.llm.sharding import op9_sharding
from ferrule.llm.suffix_dedup import OP10_SQL, op10_suffix_dedup
from ferrule.llm.token_files import op2_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_token_files": op2_token_files,
    "op3_mixing": op3_mixing,
    "op4_html_text": op4_html_text,
    "op5_chain_dedup": op5_chain_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_secrets": op7_secrets,
    "op8_decontamination": op8_decontamination,
    "op9_sharding": op9_sharding,
    "op10_suffix_dedup": op10_suffix_dedup,
    "base_quality_counts": base_quality_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": OP1_SQL,
    "op8_decontamination": OP8_SQL,
    "op10_suffix_dedup": OP10_SQL,
    "base_quality_counts": BASE_SQL,
}
