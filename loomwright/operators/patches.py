"""Keyed changes: difference of two versions, application in order, fusion by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(base: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, gone: what to change in base to get other; gone marks a key that other lacks."""
    a, b = base.select(key, F.col(value).alias("__a"), F.lit(True).alias("__in_a")), other.select(key, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    x = a.join(b, key, "full_outer")
    changed = ~F.col("__a").eqNullSafe(F.col("__b")) | F.col("__in_a").isNull() | F.col("__in_b").isNull()
    return x.where(changed).select(key, F.col("__b").alias(value), F.col("__in_b").isNull().alias("gone"))


def apply(base: DataFrame, patches: list[DataFrame], key: str, value: str) -> DataFrame:
    """base after all patches; of several that name a key the last counts. One join, whatever the number of patches."""
    if not patches:
        return base.select(key, value)
    stacked = None
    for n, p in enumerate(patches):
        one = p.select(key, F.struct(F.lit(n).alias("n"), F.col("gone"), F.col(value).alias("v")).alias("__p"))
        stacked = one if stacked is None else stacked.unionByName(one)
    last = stacked.groupBy(key).agg(F.max_by("__p", "__p.n").alias("__p"))
    x = base.select(key, value).join(last, key, "full_outer")
    return x.where("__p is null or not __p.gone").select(key, F.when(F.col("__p").isNull(), F.col(value)).otherwise(F.col("__p.v")).alias(value))


def fuse(rows: DataFrame, content: list[str], identifier: str) -> DataFrame:
    """content, least identifier and number of the rows that hold the same content."""
    return rows.groupBy(*content).agg(F.min(identifier).alias(identifier), F.count(F.lit(1)).alias("copies"))
