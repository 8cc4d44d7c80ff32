"""The queries opN_<name> and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factweave.llm.decontam import op8_decontamination
from factweave.llm.html_extract import op1_html_extraction
from factweave.llm.langid import op4_language_id
from factweave.llm.mixing import OP3_SQL, op3_mixing
from factweave.llm.neardup import op10_minhash_hamming
from factweave.llm.pii import op7_personal_data
from factweave.llm.quality import op2_quality_rules
from factweave.llm.sharding import OP5_SQL, op5_extendible_sharding
from factweave.llm.tokenbin import op6_token_ids
from factweave.llm.toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_extraction, op2_quality_rules, op3_mixing, op4_language_id, op5_extendible_sharding, op6_token_ids, op7_personal_data, op8_decontamination, op9_toxicity, op10_minhash_hamming)
}

#: The others can't be put in SQL (models, tokenizers, edit distance) or are too slow there on whole tables (op10); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op3_mixing": OP3_SQL, "op5_extendible_sharding": OP5_SQL}
