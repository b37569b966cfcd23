"""The registered queries of this subpackage; ``ORACLE_SQL`` has the SQL that DuckDB can run for some of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm.bpe import op3_bpe
from pulsegrid.llm.decontamination import op6_decontamination
from pulsegrid.llm.language import op10_language
from pulsegrid.llm.pii import op4_pii
from pulsegrid.llm.quality import op9_quality
from pulsegrid.llm.secret_scan import op2_secrets
from pulsegrid.llm.simhash import op8_simhash
from pulsegrid.llm.sql import ORACLE_SQL
from pulsegrid.llm.suffix_tree_lm import op7_suffix_tree
from pulsegrid.llm.toxicity import op1_toxicity
from pulsegrid.llm.url_filter import op5_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_secrets": op2_secrets,
    "op3_bpe": op3_bpe,
    "op4_pii": op4_pii,
    "op5_urls": op5_urls,
    "op6_decontamination": op6_decontamination,
    "op7_suffix_tree": op7_suffix_tree,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_language": op10_language,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
