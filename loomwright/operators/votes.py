"""Decisions among witnesses. Counts are partial aggregates; only counted choices, not witnesses, are ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority(rows: DataFrame, keys: list[str], choice: str) -> DataFrame:
    """keys, choice, votes, variants, tied: most votes wins, the smaller choice on a tie."""
    counted = rows.groupBy(*keys, choice).agg(F.count(F.lit(1)).alias("votes"))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("n"), choice)).alias("best"), F.count(F.lit(1)).alias("variants"), F.collect_list("votes").alias("all"))
    votes = -F.col("best.n")
    return best.select(*keys, F.col(f"best.{choice}").alias(choice), votes.alias("votes"), "variants", (F.size(F.filter("all", lambda v: v == votes)) > 1).alias("tied"))


def dominance(rows: DataFrame, keys: list[str], choice: str, share: float, least: int) -> DataFrame:
    """keys, choice, n, total, decision: `sure`, `few` (less than least rows) or `conflict` (share not reached)."""
    top = majority(rows, keys, choice).select(*keys, choice, F.col("votes").alias("n"))
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    decision = F.when(F.col("total") < least, "few").when(F.col("n") >= share * F.col("total"), "sure").otherwise("conflict")
    return top.join(totals, keys).withColumn("decision", decision)


def unanimous(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and the value all rows of a key share; keys with several values are left out."""
    return rows.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__m")).where(F.col(value) == F.col("__m")).drop("__m")


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, upper_median: the value at position n div 2 (from 0) in order; exact, from counts of equal values."""
    from pyspark.sql.window import Window

    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys)
    running = F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    x = counted.withColumn("up_to", running).withColumn("n", F.sum("c").over(w))
    return x.where(F.col("up_to") > F.expr("n div 2")).groupBy(*keys).agg(F.max("n").alias("n"), F.min(value).alias("upper_median"))


def attribution(rows: DataFrame, owner: list[str], candidate: str, witness: str) -> DataFrame:
    """owner, candidate: present on all witnesses, or on all but one of four and more; the one on most, then the smallest."""
    pairs = rows.select(*owner, candidate, witness).distinct()
    total = pairs.groupBy(*owner).agg(F.countDistinct(witness).alias("total"))
    hits = pairs.groupBy(*owner, candidate).agg(F.count(F.lit(1)).alias("hits")).join(total, owner)
    fit = hits.where((F.col("hits") == F.col("total")) | ((F.col("total") >= 4) & (F.col("hits") >= F.col("total") - 1)))
    return fit.groupBy(*owner).agg(F.min(F.struct((-F.col("hits")).alias("n"), candidate)).alias("x"), F.max("total").alias("total")).select(*owner, f"x.{candidate}", (-F.col("x.n")).alias("hits"), "total")
