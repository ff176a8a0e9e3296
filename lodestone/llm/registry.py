"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann_tree, best_fit_packing, chat_format, chosen_path, curriculum_mix, fim_rotation, katz_lm, license_scan, pii_sanitiser, quality_rules, secret_scan, turn_repair, url_filter

MODULES = [chat_format, best_fit_packing, quality_rules, pii_sanitiser, katz_lm, ann_tree, license_scan, curriculum_mix, chosen_path, url_filter, secret_scan, fim_rotation, turn_repair]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
