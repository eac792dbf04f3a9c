"""Registered queries of the text operators: each applies its operator with
production parameters to whole tables of ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lagscope.llm import (chat, collocate, decontaminate, langid, mixing, quality, secrets,
                          simhash_dedup, simprint, toxicity, warc, whitening, wrapper)
from lagscope.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": lambda spark, sf_dir: toxicity.op1(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op2_quality": lambda spark, sf_dir: quality.op2(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op3_html_text": lambda spark, sf_dir: wrapper.op3(table(spark, sf_dir, "pages")),
        "op4_simhash_dedup": _documents(simhash_dedup.op4),
        "op5_decontaminate": lambda spark, sf_dir: decontaminate.op5(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op6_fingerprints": _documents(simprint.op6),
        "op7_mix_sources": _documents(mixing.op7),
        "op8_secret_scan": _documents(secrets.op8),
        "op9_language_id": _documents(langid.op9),
        "op10_chat_format": lambda spark, sf_dir: chat.op10(
            spark, table(spark, sf_dir, "conversations")),
        "op11_whitening": lambda spark, sf_dir: whitening.op11(table(spark, sf_dir, "embeddings")),
        "op12_warc": lambda spark, sf_dir: warc.op12(table(spark, sf_dir, "pages")),
        "op13_collocations": _documents(collocate.op13),
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_chat_format": chat.ORACLE_SQL, "op12_warc": warc.ORACLE_SQL,
            "op13_collocations": collocate.ORACLE_SQL}
