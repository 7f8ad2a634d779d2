"""The queries of the training-data operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memloom.llm import bpe, decontaminate, exact, hardneg, html, media, neardup, periodic, quality, shards, substrings, tokenfile, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_near_duplicates": neardup.op2_near_duplicates,
    "op3_repeated_passages": substrings.op3_repeated_passages,
    "op4_toxicity": toxicity.op4_toxicity,
    "op6_benchmark_leaks": decontaminate.op6_benchmark_leaks,
    "op5_media_fingerprint": media.op5_media_fingerprint,
    "op7_token_files": tokenfile.op7_token_files,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_shuffle_shards": shards.op9_shuffle_shards,
    "op10_html_text": html.op10_html_text,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_hard_negatives": hardneg.op12_hard_negatives,
    "op13_exact_duplicates": exact.op13_exact_duplicates,
}

#: The other operators hash, learn, embed or parse in ways that SQL lacks, or (near duplicates) would compare all pairs in it; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op3_repeated_passages": substrings.OP3_SQL, "op12_hard_negatives": hardneg.OP12_SQL, "op13_exact_duplicates": exact.OP13_SQL}
