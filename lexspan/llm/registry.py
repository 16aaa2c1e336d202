"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, html_text, minhash, ngram_join, packing, quality, runs, sampling, simhash, spelling, sql, token_files, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op3_chat_format": chat.op3_chat_format,
    "op4_token_files": token_files.op4_token_files,
    "op5_simhash_fingerprints": simhash.op5_simhash_fingerprints,
    "op6_length_buckets": packing.op6_length_buckets,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_html_text": html_text.op8_html_text,
    "op9_sampled_segmentations": sampling.op9_sampled_segmentations,
    "op10_warc": warc.op10_warc,
    "op11_minhash": minhash.op11_minhash,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": sql.near_duplicates(ngram_join.WIDTH, ngram_join.P, kept=False),
    "op3_chat_format": chat.ORACLE,
    "op10_warc": sql.WARC,
    "op11_minhash": sql.near_duplicates(minhash.WIDTH, minhash.P, kept=True),
    "op12_spelling_variants": sql.SPELLING,
    "op13_periodic_runs": sql.RUNS,
}
