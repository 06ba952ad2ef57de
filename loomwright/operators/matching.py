"""Matches of texts with names and with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import word_grams
from loomwright.operators.ranges import checked_rules


#: Trigrams of items that may be broadcast (about 40 MB).
SMALL_GRAMS = 400_000


def longest_alias(rows: DataFrame, text: str, aliases: DataFrame) -> DataFrame:
    """rows with `target` and `alias`: of the aliases that stand in the folded text as whole words, the longest; the last place, then the smaller alias on a tie.

    aliases (alias, target) are a checked small table that goes to the tasks
    as one array, so rows neither multiply nor move.
    """
    aliases = checked_rules(aliases)  # counted before they become one row
    table = aliases.agg(F.array_sort(F.collect_list(F.struct("alias", "target"))).alias("__all"))
    padded = F.concat(F.lit(" "), F.col(text), F.lit(" "))
    place = lambda a: F.length(padded) - F.instr(F.reverse(padded), F.reverse(F.concat(F.lit(" "), a["alias"], F.lit(" "))))
    hits = F.filter("__all", lambda a: F.contains(padded, F.concat(F.lit(" "), a["alias"], F.lit(" "))))
    ranked = F.array_sort(F.transform(hits, lambda a: F.struct((-F.length(a["alias"])).alias("n"), (-place(a)).alias("at"), a["alias"].alias("alias"), a["target"].alias("target"))))
    x = rows.join(F.broadcast(table), F.lit(True), "left").withColumn("__best", F.try_element_at(ranked, F.lit(1)))
    return x.withColumn("alias", F.col("__best.alias")).withColumn("target", F.col("__best.target")).drop("__all", "__best")


def trigram_votes(rows: DataFrame, row_id: str, text: str, items: DataFrame, item_id: str, item_text: str, share: float) -> DataFrame:
    """row_id, item_id, votes, size of the item of which a row shares most distinct word trigrams, if at least `share` of the item's; the smaller id on a tie."""
    grams = items.select(item_id, F.explode(word_grams(F.col(item_text))).alias("gram"))
    sizes = grams.groupBy(item_id).agg(F.count(F.lit(1)).alias("size"))
    if grams.limit(SMALL_GRAMS + 1).count() <= SMALL_GRAMS:  # they go to the rows, whose trigrams then needn't move
        grams = F.broadcast(grams)
    mine = rows.select(row_id, F.explode(word_grams(F.col(text))).alias("gram"))
    votes = mine.join(grams, "gram").groupBy(row_id, item_id).agg(F.count(F.lit(1)).alias("votes")).join(sizes, item_id).where(F.col("votes") >= share * F.col("size"))
    best = F.min(F.struct((-F.col("votes")).alias("n"), item_id, "size")).alias("x")
    return votes.groupBy(row_id).agg(best).select(row_id, f"x.{item_id}", (-F.col("x.n")).alias("votes"), "x.size")


def near_dates(left: DataFrame, right: DataFrame, date: str, key: str, reach: int = 1) -> DataFrame:
    """left rows with the right row of an equal key whose date is nearest within `reach` days; the earlier date on a tie.

    The right side is spread over its possible dates, so the join is an equi-join.
    """
    spread = right.withColumn("__off", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("__date", F.expr(f"date_add({date}, __off)"))
    spread = spread.select(F.col(key), F.col("__date").alias(date), F.struct(F.abs("__off").alias("far"), F.col(date).alias("found"), *[F.col(c) for c in right.columns if c not in (key, date)]).alias("x"))
    nearest = spread.groupBy(key, date).agg(F.min("x").alias("x"))
    return left.join(nearest, [key, date], "left")
