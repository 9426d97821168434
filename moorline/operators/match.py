"""Records compared by structure: nested JSON as long rows of path, type and value."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _leaves(value: object, path: str = "") -> Iterator[tuple[str, str, str | None, float | None]]:
    if isinstance(value, dict | list):
        yield path, "object" if isinstance(value, dict) else f"array of {len(value)}", None, None
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            yield from _leaves(v, f"{path}/{k}")
    elif value is None or isinstance(value, bool | str):
        yield path, "null" if value is None else type(value).__name__, json.dumps(value), None
    else:
        yield path, type(value).__name__, None, float(value)


def flattened(records: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, path, type, text, number of every node of the JSON texts in a column; a text that is no JSON is one node of type invalid, null has none."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.select(*keys).schema) + ", path string, type string, text string, number double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for k, x in enumerate(batch.column(len(keys)).to_pylist()):
                if x is None:
                    continue
                try:
                    found = [*_leaves(json.loads(x))]
                except ValueError:
                    found = [("", "invalid", x, None)]
                rows += found
                at += [k] * len(found)
            take = pa.array(at, pa.int64())
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(keys))), *cols], names=[*keys, "path", "type", "text", "number"])

    return records.select(*keys, column).mapInArrow(run, ddl)


def differences(expected: DataFrame, actual: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """keys, path, problem of two flattened tables: missing, unexpected, type or value. Whole numbers and texts must be equal, others within tolerance * (1 + |expected|); 1 and 1.0 are both numbers."""
    on = [*keys, "path"]
    side = lambda df, p: df.select(*on, *(F.col(c).alias(p + c) for c in ("type", "text", "number")))
    both = side(expected, "e_").join(side(actual, "a_"), on, "full_outer")
    numbers = F.col("e_number").isNotNull() & F.col("a_number").isNotNull()
    near = F.abs(F.col("e_number") - F.col("a_number")) <= F.when((F.col("e_type") == "int") & (F.col("a_type") == "int"), 0.0).otherwise(tolerance * (1 + F.abs("e_number")))
    problem = F.when(F.col("a_type").isNull(), "missing").when(F.col("e_type").isNull(), "unexpected").when(numbers, F.when(~near, "value")).when(F.col("e_type") != F.col("a_type"), "type").when(~F.col("e_text").eqNullSafe(F.col("a_text")), "value")
    return both.select(*on, problem.alias("problem")).filter("problem is not null")
