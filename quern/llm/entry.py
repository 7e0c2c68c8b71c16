"""The queries of this subpackage and their SQL, for the driver."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

_QUERIES = {
    "op6_line_dedup": "line_dedup",
    "op1_warc": "warc",
    "op2_decontaminate": "decontaminate",
    "op3_pii": "pii",
    "op4_cotraining": "cotraining",
    "op5_quality_rules": "quality_rules",
    "op7_license_scan": "license_scan",
    "op8_bpe": "bpe",
    "op9_simhash_dedup": "simhash_dedup",
    "op10_html_extract": "html_extract",
}


def queries() -> dict[str, Callable]:
    """By name: functions of (spark, sf_dir)."""
    return {name: getattr(import_module(f"quern.llm.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those queries that SQL can express."""
    modules = {name: import_module(f"quern.llm.{module}") for name, module in _QUERIES.items()}
    return {name: module.SQL for name, module in modules.items() if getattr(module, "SQL", None)}
