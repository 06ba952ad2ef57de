"""Joins and merges of names and short texts that are nearly equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deletions(rows: DataFrame, text: str, keys: list[str], most: int) -> DataFrame:
    """keys and __form: each text's distinct forms with up to `most` (0 to 2) letters left out. Two texts within that edit distance share a form."""
    n = F.length(text)
    out_of = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1, F.length(t))))
    forms = F.array(F.col(text))
    for _ in range(most):
        forms = F.array_distinct(F.concat(forms, F.flatten(F.transform(forms, out_of))))
    return rows.where(n.isNotNull()).select(*keys, text, F.explode(forms).alias("__form")).distinct()


def edit_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str, most: int = 2) -> DataFrame:
    """left_id, right_id, distance of all pairs of short texts within an edit distance of `most` (0 to 2).

    Texts meet by the forms that deletions leave, an equi-join; so no pair is
    missed and no pair of unlike texts is made but where such a form is shared.
    Equal texts are joined once per different text.
    """
    a = deletions(left.select(F.col(text).alias("__a")).distinct(), "__a", [], most)
    b = deletions(right.select(F.col(text).alias("__b")).distinct(), "__b", [], most)
    near = a.join(b, "__form").select("__a", "__b").distinct().withColumn("distance", F.levenshtein("__a", "__b")).where(F.col("distance") <= most)
    x = left.select(left_id, F.col(text).alias("__a")).join(near, "__a").join(right.select(right_id, F.col(text).alias("__b")), "__b")
    return x.select(left_id, right_id, "distance")


def merge_typos(names: DataFrame, name: str, many: str, most: int = 2) -> DataFrame:
    """name, merged: the most frequent name within the edit distance that is more frequent than the name itself (its own, without one).

    names: name, many (how often it occurs), one row a name. Ties go to the
    nearer, then the smaller name. A name merges into the named one in one
    step; chains are not followed.
    """
    x = edit_join(names, names.withColumnRenamed(many, "__m").withColumnRenamed(name, "__t").select(F.col("__t").alias(name), F.col("__t").alias("__other"), "__m"), name, "__other", name, most)
    counts = names.select(F.col(name).alias("__other"), F.col(many).alias("__m"))
    x = x.join(counts, "__other").join(names.select(name, many), name).where(F.col("__m") > F.col(many))
    best = x.groupBy(name).agg(F.min(F.struct((-F.col("__m")).alias("m"), "distance", "__other")).alias("x")).select(name, F.col("x.__other").alias("__best"))
    return names.select(name).join(best, name, "left").select(name, F.coalesce("__best", name).alias("merged"))


def merge_token_sets(names: DataFrame, name: str, many: str, tokens: str) -> DataFrame:
    """name, merged: names equal as sets of words go by the most frequent one of them, the smaller on a tie."""
    key = names.select(name, many, F.array_sort(F.array_distinct(tokens)).alias("__set"))
    best = key.groupBy("__set").agg(F.min(F.struct((-F.col(many)).alias("m"), name)).alias("x")).select("__set", F.col(f"x.{name}").alias("merged"))
    return key.join(best, "__set").select(name, "merged")


def net_new(ours: DataFrame, theirs: DataFrame, key: str, least: int = 25) -> DataFrame:
    """Rows of theirs with a key of `least` characters or more that ours doesn't have."""
    return theirs.where(F.length(key) >= least).join(ours.select(key).distinct(), key, "left_anti")


def incipit_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str, n: int = 4) -> DataFrame:
    """left_id, right_id: each left row with the smallest right id whose text begins with the same n words; texts of fewer words meet none."""
    begin = F.when(F.size(tokens) >= n, F.array_join(F.slice(tokens, 1, n), " ")).alias("__begin")
    first = right.select(right_id, begin).where("__begin is not null").groupBy("__begin").agg(F.min(right_id).alias(right_id))
    return left.select(left_id, begin).join(first, "__begin", "left").select(left_id, right_id)
