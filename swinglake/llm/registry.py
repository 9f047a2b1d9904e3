"""The queries of this subpackage and the SQL that states some of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from swinglake.llm import chat, exact, knn, langid, lexical, lm, mixing, packing, quality, repair, sharding, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_simhash": simhash.op2_simhash,
    "op3_packing": packing.op3_packing,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality": quality.op6_quality,
    "op7_langid": langid.op7_langid,
    "op8_exact_dedup": exact.op8_exact_dedup,
    "op9_lm_scoring": lm.op9_lm_scoring,
    "op10_sharding": sharding.op10_sharding,
    "op11_repair": repair.op11_repair,
    "op12_lexical": lexical.op12_lexical,
    "op13_knn": knn.op13_knn,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.OP1_SQL,
    "op4_chat_formatting": chat.OP4_SQL,
    "op8_exact_dedup": exact.OP8_SQL,
    "op11_repair": repair.OP11_SQL,
    "op12_lexical": lexical.OP12_SQL,
    "op13_knn": knn.OP13_SQL,
}
