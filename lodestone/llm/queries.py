"""The queries of this subpackage and, where SQL can express one, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import chat, fingerprints, language, lines, minhash, mixing, packing, quality_mil, quality_rules, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality_mil.query,
        "op2_line_dedup": lines.query,
        "op3_chat_formatting": chat.query,
        "op4_fingerprints": fingerprints.query,
        "op5_toxicity": toxicity.query,
        "op6_quality_rules": quality_rules.query,
        "op7_language_id": language.query,
        "op8_packing": packing.query,
        "op9_mixing": mixing.query,
        "op10_minhash": minhash.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": lines.SQL, "op3_chat_formatting": chat.SQL, "op9_mixing": mixing.SQL}
