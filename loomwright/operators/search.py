"""Look-ups over folded texts, and answers with patches applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions import text


def has_all_words(folded: Column, words: list[str]) -> Column:
    """Whether a folded text holds all the words as parts."""
    out = F.lit(True)
    for w in words:
        out = out & F.contains(folded, F.lit(w))
    return out


def hits_by_group(rows: DataFrame, group: str, folded: str, words: list[str]) -> DataFrame:
    """group, hits, total of all groups, those without a hit too."""
    return rows.groupBy(group).agg(F.count_if(has_all_words(F.col(folded), words)).alias("hits"), F.count(F.lit(1)).alias("total"))


def key_contains(rows: DataFrame, key: str, part: str, most: int = 60) -> DataFrame:
    """The first `most` rows by key whose key holds the part (a report's length, so the limit is the feature)."""
    return rows.where(F.contains(F.col(key), F.lit(part))).orderBy(key).limit(most)


def candidates_with_fallback(sources: list[DataFrame], keys: list[str], item: str, fallback: DataFrame, group: str) -> DataFrame:
    """keys, item, place: the items of all sources in their order, each once; keys without any get those of their group from fallback (group, item, place).

    sources: keys, group, item, place (anything with an order); the first
    source comes first. A single source that is dealt by its keys already is
    not shuffled again, so whoever deals it says how much a task holds.
    """
    out = None
    for n, df in enumerate(sources):
        part = df.select(*keys, group, F.lit(n).alias("__source"), item, "place")
        out = part if out is None else out.unionByName(part)
    # a row for each item of a key, and one for each group of a key that a source has no item for
    first = out.groupBy(*keys, item, F.when(F.col(item).isNull(), F.col(group)).alias("__group")).agg(F.min(F.struct("__source", "place")).alias("__at"))
    order = Window.partitionBy(*keys).orderBy(F.col(item).isNull(), "__at", item)
    listed = first.select(*keys, item, "__group", F.row_number().over(order).alias("place"), F.first(item).over(order).alias("__any"))
    own = listed.where(F.col(item).isNotNull()).select(*keys, item, "place")
    empty = listed.where(F.col("__any").isNull()).select(*keys, F.col("__group").alias(group))
    return own.unionByName(empty.join(fallback.select(group, item, "place"), group).select(*keys, item, "place"))


def patched(base: DataFrame, patches: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """base with the last patch of each key applied: a null value removes the row, keys that base lacks are added."""
    last = patches.groupBy(key).agg(F.max_by(F.struct(value), order).alias("__p"))
    x = base.select(key, value, F.lit(True).alias("__base")).join(last, key, "full_outer")
    hit = F.col("__p").isNotNull()
    x = x.select(key, F.when(hit, F.col(f"__p.{value}")).otherwise(F.col(value)).alias(value), (hit & F.col(f"__p.{value}").isNull()).alias("__gone"))
    return x.where("not __gone").drop("__gone")


def applicable(items: DataFrame, spans: DataFrame, group: str, key: str, day_number: Column, low: str, high: str, default: str) -> DataFrame:
    """items with the keys of spans (a small table: group, key, low, high as month * 100 + day, default) that apply on their day; spans may wrap the year; a default only where nothing else of the group applies."""
    x = items.withColumn("__md", day_number).join(F.broadcast(spans), group)
    md = F.col("__md")
    inside = F.when(F.col(low) <= F.col(high), (md >= F.col(low)) & (md <= F.col(high))).otherwise((md >= F.col(low)) | (md <= F.col(high)))
    hits = x.withColumn("__in", ~F.col(default) & inside)
    ids = items.columns
    best = hits.groupBy(*ids).agg(F.collect_list(F.when(F.col("__in"), F.col(key))).alias("__hits"), F.collect_list(F.when(F.col(default), F.col(key))).alias("__defaults"))
    chosen = F.when(F.size("__hits") > 0, F.col("__hits")).otherwise(F.col("__defaults"))
    return best.select(*ids, F.explode(chosen).alias(key))


def highlighted(rows: DataFrame, source: str, words: str, before: int = 45, after: int = 90) -> DataFrame:
    """rows whose text holds the words when folded, with `snippet` around the first place."""
    return rows.withColumn("snippet", text.snippet(F.col(source), F.lit(words), before, after)).where("snippet is not null")
