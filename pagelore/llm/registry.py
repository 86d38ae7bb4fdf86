"""Queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelore.llm import chat_format, decontaminate, exact_dedup, html_extract, ngram_join, quality, sentencepiece_codec, substring_dedup, token_planes, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
        "op3_html_extract": html_extract.op3_html_extract,
        "op4_token_planes": token_planes.op4_token_planes,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_chat_format": chat_format.op6_chat_format,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_ngram_join": ngram_join.SQL,
        "op6_chat_format": chat_format.SQL,
        "op8_decontamination": decontaminate.SQL,
        "op10_exact_dedup": exact_dedup.SQL,
    }
