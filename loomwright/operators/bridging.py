"""Pairs of two sides in which each row is used once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.sources.shared import new_path


def _staged(df: DataFrame, what: str) -> DataFrame:
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def match_once(pairs: DataFrame, left: str, right: str, order: list[str | Column]) -> DataFrame:
    """The pairs that a walk in `order` (then left, right) takes if it takes each pair whose two sides are still free.

    Every round takes all pairs that come first both for their left and for
    their right side: the walk takes those too, whatever it did before. So a
    round is two aggregates and no group is walked by one task; the number of
    rounds is that of the longest chain of pairs in which each waits for the
    one before. Pairs with a null side or in a row twice count once or not.
    """
    place = F.struct(*[(c if isinstance(c, Column) else F.col(c)).alias(f"o{i}") for i, c in enumerate([*order, left, right])])
    kept = pairs.columns
    alive = _staged(pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).withColumn("__place", place).dropDuplicates([left, right]), "pairs")
    done = alive.limit(0)
    while alive.limit(1).count():
        by_left = alive.groupBy(left).agg(F.min("__place").alias("__place")).select("__place")
        by_right = alive.groupBy(right).agg(F.min("__place").alias("__place")).select("__place")
        taken = _staged(alive.join(by_left, "__place", "left_semi").join(by_right, "__place", "left_semi"), "taken")
        done = done.unionByName(taken)
        alive = _staged(alive.join(taken.select(left), left, "left_anti").join(taken.select(right), right, "left_anti"), "pairs")
    return done.select(*kept)


def bridge_candidates(left: DataFrame, right: DataFrame, scope: str, left_id: str, right_id: str, date: str, words: str, reach: int = 7, alike: float = 0.2, surely: float = 0.5) -> DataFrame:
    """scope, left_id, right_id, date of the left row, tier, score: which right row may be meant by a left row.

    tier 0: the date is the same and the names are alike; 1: the names are
    surely alike within `reach` days; 2: nothing else of that scope has the
    date. score: shared words as a share of the shorter name. Rows meet by
    scope and week, so only neighbours in time are compared. Null dates and
    scopes meet nothing; null arrays have no words.
    """
    week = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01")) / (reach + 1)).cast("long")
    mine = left.select(scope, left_id, F.col(date), F.coalesce(words, F.array().cast("array<string>")).alias("__a")).withColumn("__week", F.explode(F.array(*[week(F.col(date)) + k for k in (-1, 0, 1)])))
    lone = right.where(F.col(date).isNotNull()).groupBy(scope, date).agg(F.count(F.lit(1)).alias("__same"))
    other = right.join(lone, [scope, date]).select(scope, right_id, F.col(date).alias("__date"), F.coalesce(words, F.array().cast("array<string>")).alias("__b"), week(F.col(date)).alias("__week"), "__same")
    met = mine.join(other, [scope, "__week"]).where(F.abs(F.datediff(F.col(date), "__date")) <= reach)
    least = F.least(F.size("__a"), F.size("__b"))
    met = met.withColumn("score", F.when(least > 0, F.size(F.array_intersect("__a", "__b")) / least).otherwise(0.0))
    same = F.col(date) == F.col("__date")
    tier = F.when(same & (F.col("score") >= alike), 0).when(~same & (F.col("score") >= surely), 1).when(same & (F.col("__same") == 1), 2)
    return met.withColumn("tier", tier).where(F.col("tier").isNotNull()).select(scope, left_id, right_id, date, "tier", "score")


def bridge_once(left: DataFrame, right: DataFrame, scope: str, left_id: str, right_id: str, date: str, words: str, reach: int = 7) -> DataFrame:
    """bridge_candidates() of left rows in order of date and id; each takes its best right row that no earlier one took, and ends up without one if none is left."""
    pairs = bridge_candidates(left, right, scope, left_id, right_id, date, words, reach)
    return match_once(pairs, left_id, right_id, [F.col(date), F.col(left_id), F.col("tier"), -F.col("score"), F.col(right_id)])
