"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from winnow.llm import cap_dedup, kd_search, language_id, lattice_lm, line_dedup, mixing, nbest_pieces, ngram_join, suffix_dedup, token_align, toxicity, warc_zip, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_cap_dedup": cap_dedup.op2_cap_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_top_k": kd_search.op4_top_k,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_lattice_lm": lattice_lm.op8_lattice_lm,
    "op9_warc_zip": warc_zip.op9_warc_zip,
    "op10_nbest_pieces": nbest_pieces.op10_nbest_pieces,
    "op11_token_align": token_align.op11_token_align,
    "op12_whitening": whitening.op12_whitening,
    "op13_language_id": language_id.op13_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": ngram_join.ORACLE_SQL,
    "op2_cap_dedup": cap_dedup.ORACLE_SQL,
    "op3_mixing": mixing.ORACLE_SQL,
    "op4_top_k": kd_search.ORACLE_SQL,
    "op7_line_dedup": line_dedup.ORACLE_SQL,
    "op9_warc_zip": warc_zip.ORACLE_SQL,
}
