"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heliograph.llm import ans, decontaminate, exact, htmltext, merkle, packing, pii, secrets, simhash, spelling, substrings, syncmers, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_html_text": htmltext.op2_html_text,
        "op3_pii": pii.op3_pii,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
        "op6_token_files": ans.op6_token_files,
        "op7_syncmers": syncmers.op7_syncmers,
        "op8_secret_scan": secrets.op8_secret_scan,
        "op9_substring_dedup": substrings.op9_substring_dedup,
        "op10_packing": packing.op10_packing,
        "op11_exact_dedup": exact.op11_exact_dedup,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_substring_dedup": substrings.ORACLE_SQL,
        "op11_exact_dedup": exact.ORACLE_SQL,
        "op12_spelling_variants": spelling.ORACLE_SQL,
        "op13_merkle_manifest": merkle.ORACLE_SQL,
    }
