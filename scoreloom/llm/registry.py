"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoreloom.llm import bagminhash, ball_tree, chat, decision_lists, html_text, knn_join, line_dedup, media, mixing, sentencepiece_codec, surrogates, toxicity, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": chat.op1_chat,
        "op2_mixing": mixing.op2_mixing,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_html": html_text.op4_html,
        "op5_bagminhash": bagminhash.op5_bagminhash,
        "op6_media": media.op6_media,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_knn": knn_join.op8_knn,
        "op9_surrogates": surrogates.op9_surrogates,
        "op10_sentencepiece": sentencepiece_codec.op10_sentencepiece,
        "op11_decision_lists": decision_lists.op11_decision_lists,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_ball_tree": ball_tree.op13_ball_tree,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": chat.CHAT_SQL, "op2_mixing": mixing.mixing_sql(), "op8_knn": knn_join.KNN_SQL, "op12_vector_codes": vector_codes.codes_sql(), "op13_ball_tree": ball_tree.ball_sql()}
