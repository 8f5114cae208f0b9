"""Queries opN_<name> of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import byte_bpe, chat, decontaminate, hard_negatives, language, minhash, packing, pii, quality_net, quality_rules, spelling, token_counts, wavelet


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1_query,
        "op2_chat_format": chat.op2_query,
        "op3_wavelet": wavelet.op3_query,
        "op4_decontamination": decontaminate.op4_query,
        "op5_minhash": minhash.op5_query,
        "op6_packing": packing.op6_query,
        "op7_language_id": language.op7_query,
        "op8_quality_net": quality_net.op8_query,
        "op9_quality_rules": quality_rules.op9_query,
        "op10_token_counts": token_counts.op10_query,
        "op11_byte_bpe": byte_bpe.op11_query,
        "op12_hard_negatives": hard_negatives.op12_query,
        "op13_spelling": spelling.op13_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat.OP2_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL}
