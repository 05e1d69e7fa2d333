"""Arrow batches through plain Python functions on lists of values."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def seldom_collect() -> None:
    """Let a Python worker look for cycles of garbage seldom: these functions make none, but hold many small objects that each search goes through."""
    gc.set_threshold(500_000, 20, 100)


def map_lists(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """``make()`` runs once per task and gives a function of a batch's columns, as lists, to output rows.

    A batch of very many output rows is cut, so that a batch of Arrow data stays small whatever a row turns into.
    """
    spark_schema = StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(spark_schema)

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(arrow_schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)

    def run(batches):
        f = make()
        seldom_collect()
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for row in f(*[c.to_pylist() for c in batch.columns]):
                rows.append(row)
                size += sum(len(x) for x in row if isinstance(x, (str, bytes, list)))
                if len(rows) >= 20_000 or size >= 16_000_000:
                    yield flush(rows)
                    rows, size = [], 0
            if rows:
                yield flush(rows)

    return df.mapInArrow(run, spark_schema)
