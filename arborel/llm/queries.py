"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

import importlib

#: module and function of each operator's query
NAMES = ["op1_mixing", "op2_secrets", "op3_urls", "op4_toxicity", "op5_minhash", "op6_chunks", "op7_lines", "op8_pii", "op9_tokens", "op10_decontaminate"]


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = {}
    for name in NAMES:
        found[name] = getattr(importlib.import_module(f"{__package__}.{name}"), name)
    return found | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in NAMES:
        if sql := getattr(importlib.import_module(f"{__package__}.{name}"), "SQL", None):
            found[name] = sql
    return found
