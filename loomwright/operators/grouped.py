"""Groups of rows inside tasks: Spark deals rows out by key and sorts them, a task reads one group after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame


def rows_in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def by_key(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[list[tuple]], Iterable[tuple]], schema: str, spread: list[str] | None = None) -> DataFrame:
    """What `work` yields for the rows of each key, in order; rows are tuples of keys, then the other columns as they stand.

    Many small groups share a task and an Arrow batch. A group is held in one
    task; `spread` (a part of the keys, all of them if not given) decides
    which groups meet there. Null keys are a group of their own. Nothing is
    yielded for a table without rows.
    """
    spark = rows.sparkSession
    names = [*keys, *[c for c in rows.columns if c not in keys]]
    dealt = rows.select(*names).repartition(*(spread or keys)).sortWithinPartitions(*keys, *order)
    fields = spark.createDataFrame([], schema).schema
    kinds = pa.schema([(f.name, _arrow(f.dataType)) for f in fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, group in groupby(rows_in_order(batches), lambda r: r[: len(keys)]):
            out.extend(work(list(group)))
            if len(out) >= 10_000:
                yield _batch(out, kinds)
                out = []
        yield _batch(out, kinds)

    return dealt.mapInArrow(run, fields)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
