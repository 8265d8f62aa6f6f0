"""The ten operators' queries and the pipeline, as registered, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import bpe_fst, chat_format, line_templates, packing, parity_join, passage_dedup, spotsigs, stream_dedup, toxicity_fm, url_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_spotsigs": spotsigs.op1_spotsigs,
        "op2_parity_join": parity_join.op2_parity_join,
        "op3_line_templates": line_templates.op3_line_templates,
        "op4_bpe_codec": bpe_fst.op4_bpe_codec,
        "op5_toxicity": toxicity_fm.op5_toxicity,
        "op6_exact_dedup": stream_dedup.op6_exact_dedup,
        "op7_url_rules": url_rules.op7_url_rules,
        "op8_chat_format": chat_format.op8_chat_format,
        "op9_passage_dedup": passage_dedup.op9_passage_dedup,
        "op10_pack": packing.op10_pack,
        "pipeline": corpus_pipeline.run,
    }


def oracles() -> dict[str, str]:
    found = {
        "op3_line_templates": line_templates.OP3_SQL,
        "op6_exact_dedup": stream_dedup.OP6_SQL,
        "op7_url_rules": url_rules.OP7_SQL,
        "op8_chat_format": chat_format.OP8_SQL,
    }
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
