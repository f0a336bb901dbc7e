"""The queries of this folder's operators, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearken.llm import decontaminate, html, mixing, pii, pipeline, quality, simhash, tokens, toxicity, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_html_text": html.op2_html_text,
    "op3_url_filters": urls.op3_url_filters,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_warc": warc.op6_warc,
    "op7_simhash": simhash.op7_simhash,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_token_ids": tokens.op9_token_ids,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "pipeline": pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": mixing.OP4_SQL,
    "op6_warc": warc.OP6_SQL,
}
