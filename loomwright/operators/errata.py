"""Replay of a log of corrections on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(texts: DataFrame, log: DataFrame, key: str, text: str) -> DataFrame:
    """texts with text after its key's corrections log(key, n, find, put) in order of n, and applied: how many did something.

    A correction is applied only where `find` is in the text exactly once at
    its turn, so a replay never touches a second place. A key's corrections go
    with each of its texts; keys without any keep their text, null texts stay
    null. Nothing but the corrections of one key is gathered.
    """
    own = log.where("find <> ''").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "find", "put"))).alias("__log"))
    x = texts.join(own, key, "left")

    def step(s, e):
        once = (F.length(s["text"]) - F.length(F.replace(s["text"], e["find"], F.lit("")))) == F.length(e["find"])
        return F.struct(
            F.when(once, F.replace(s["text"], e["find"], F.coalesce(e["put"], F.lit("")))).otherwise(s["text"]).alias("text"),
            (s["applied"] + F.when(once, 1).otherwise(0)).cast("int").alias("applied"),
        )

    start = F.struct(F.col(text).cast("string").alias("text"), F.lit(0).alias("applied"))
    done = F.aggregate(F.coalesce("__log", F.array().cast("array<struct<n:int,find:string,put:string>>")), start, step)
    return x.withColumn("__done", done).withColumn(text, F.col("__done.text")).withColumn("applied", F.col("__done.applied")).drop("__log", "__done")
