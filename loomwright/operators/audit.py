"""Counts held against each other: crosschecks, reconciliations, facts side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_crosscheck(asked: DataFrame, got: DataFrame, keys: list[str], explained: DataFrame) -> DataFrame:
    """keys, asked, got, status: equal, explained (the key is in `explained`) or differs. asked(keys, asked), got(keys, got): one row a key."""
    x = asked.join(got, keys, "full_outer").join(explained.select(*keys).distinct().withColumn("__why", F.lit(True)), keys, "left")
    x = x.withColumn("asked", F.coalesce("asked", F.lit(0))).withColumn("got", F.coalesce("got", F.lit(0)))
    status = F.when(F.col("asked") == F.col("got"), "equal").when(F.col("__why"), "explained").otherwise("differs")
    return x.withColumn("status", status).drop("__why")


def reconcile(index: DataFrame, content: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place: both, index or content, of every key that one side has."""
    a = index.select(*keys).distinct().withColumn("__a", F.lit(1))
    b = content.select(*keys).distinct().withColumn("__b", F.lit(1))
    place = F.when(F.col("__a").isNull(), "content").when(F.col("__b").isNull(), "index").otherwise("both")
    return a.join(b, keys, "full_outer").select(*keys, place.alias("place"))


def facts(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Unpivoted: keys, fact, value (as text)."""
    return rows.select(*keys, *[F.col(v).cast("string").alias(v) for v in values]).unpivot(keys, values, "fact", "value")


def fact_audit(computed: DataFrame, printed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, fact, computed, printed of all facts that differ; a missing row differs in all that the other side has."""
    a = facts(computed, keys, values).withColumnRenamed("value", "computed")
    b = facts(printed, keys, values).withColumnRenamed("value", "printed")
    return a.join(b, [*keys, "fact"], "full_outer").where(~F.col("computed").eqNullSafe(F.col("printed")))


def coverage(items: DataFrame, seen: DataFrame, item: str, day: str) -> DataFrame:
    """items with coverage: own_day (seen on its day), other_day (only on others) or never. items: one row an item and day."""
    any_day = seen.select(item).distinct().withColumn("__any", F.lit(True))
    same_day = seen.select(item, day).distinct().withColumn("__own", F.lit(True))
    x = items.join(same_day, [item, day], "left").join(any_day, item, "left")
    return x.withColumn("coverage", F.when(F.col("__own"), "own_day").when(F.col("__any"), "other_day").otherwise("never")).drop("__own", "__any")


def share_of_total(rows: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """keys, n, share: rows of each key and their share of all rows of the outer keys."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*within).agg(F.sum("n").alias("__t"))
    return n.join(total, within).withColumn("share", F.col("n") / F.col("__t")).drop("__t")


def histogram_of_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """size, keys: how many keys have so many rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("keys"))


def inverted_index(rows: DataFrame, value: list[str], place: list[str]) -> DataFrame:
    """value, places (ordered, each once), n."""
    x = rows.select(*value, F.struct(*place).alias("place")).distinct()
    return x.groupBy(*value).agg(F.array_sort(F.collect_list("place")).alias("places"), F.count(F.lit(1)).alias("n"))


def best_agreement(ours: DataFrame, theirs: DataFrame, keys: list[str], tokens: str, bins: list[tuple[float, str]], rest: str) -> DataFrame:
    """keys, similarity, bin: the best share of common tokens (of the larger set) over all pairs of candidates of a key; keys without a candidate have none.

    bins: (least similarity, name) from high to low. Candidates of a key are few;
    both sides hold token arrays.
    """
    a = ours.select(*keys, F.array_distinct(tokens).alias("__a"))
    b = theirs.select(*keys, F.array_distinct(tokens).alias("__b"))
    score = F.size(F.array_intersect("__a", "__b")) / F.greatest(F.size("__a"), F.size("__b"))
    x = a.join(b, keys, "left").groupBy(*keys).agg(F.max(score).alias("similarity"))
    name: Column | None = None
    for least, label in bins:
        name = F.when(F.col("similarity") >= least, label) if name is None else name.when(F.col("similarity") >= least, label)
    return x.withColumn("bin", F.when(F.col("similarity").isNull(), "no witness").otherwise(name.otherwise(rest)))
