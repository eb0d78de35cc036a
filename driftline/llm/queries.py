"""The registered queries of this subpackage and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.llm.embedding_dedup import OP1_SQL, op1_embedding_dedup
from driftline.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from driftline.llm.language_id import op8_language_id
from driftline.llm.merkle import OP11_SQL, op11_merkle_manifest
from driftline.llm.mixing import OP9_SQL, op9_mix_sources
from driftline.llm.ngram_join import OP5_SQL, op5_ngram_join
from driftline.llm.pieces import op4_sentencepiece
from driftline.llm.pii import OP13_SQL, op13_pii
from driftline.llm.pq_codes import OP12_SQL, op12_vector_codes
from driftline.llm.quality import op3_quality
from driftline.llm.substring_dedup import OP10_SQL, op10_substring_dedup
from driftline.llm.toxicity import op6_toxicity
from driftline.llm.warc import OP7_SQL, op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality": op3_quality,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_ngram_join": op5_ngram_join,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_language_id": op8_language_id,
    "op9_mix_sources": op9_mix_sources,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_vector_codes": op12_vector_codes,
    "op13_pii": op13_pii,
}

SQL: dict[str, str] = {
    "op1_embedding_dedup": OP1_SQL,
    "op2_exact_dedup": OP2_SQL,
    "op5_ngram_join": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op9_mix_sources": OP9_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_pii": OP13_SQL,
}
