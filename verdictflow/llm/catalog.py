"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdictflow.llm.bpe import op7_byte_bpe
from verdictflow.llm.decontamination import OP4_SQL, op4_decontamination
from verdictflow.llm.divergence import OP12_SQL, op12_source_divergence
from verdictflow.llm.language import op10_language_id
from verdictflow.llm.lm import op3_lm_scoring
from verdictflow.llm.near_dedup import op6_near_dedup
from verdictflow.llm.packing import op13_sequence_packing
from verdictflow.llm.quality import op8_quality_rules
from verdictflow.llm.secrets import op9_secret_scans
from verdictflow.llm.sharding import op1_sharding
from verdictflow.llm.substring_dedup import op2_suffix_dedup
from verdictflow.llm.toxicity import op5_toxicity
from verdictflow.llm.vector_codes import OP11_SQL, op11_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_sharding, op2_suffix_dedup, op3_lm_scoring, op4_decontamination, op5_toxicity, op6_near_dedup, op7_byte_bpe, op8_quality_rules, op9_secret_scans, op10_language_id, op11_vector_codes, op12_source_divergence, op13_sequence_packing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": OP4_SQL, "op11_vector_codes": OP11_SQL, "op12_source_divergence": OP12_SQL}
