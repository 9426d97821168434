"""The queries of the operators for training text, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from moorline.llm import areas, forms, leaks, near, overlap, packing, personal, records, splits, toxic

_modules = (records, forms, toxic, near, overlap, splits, personal, packing, leaks, areas)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _modules for name, f in vars(m).items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
