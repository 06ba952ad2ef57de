"""Consensus among witnesses by further rules. Votes are counted before they move; only counted choices are ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators.ranges import checked_rules


def majority_with_priority(rows: DataFrame, keys: list[str], choice: str, primary: Column) -> DataFrame:
    """keys, choice, votes, by_primary: choices that a primary witness backs come first, then most votes, then the smaller choice."""
    counted = rows.groupBy(*keys, choice).agg(F.count(F.lit(1)).alias("votes"), F.max(F.coalesce(primary, F.lit(False)).cast("int")).alias("primary"))
    best = F.min(F.struct((-F.col("primary")).alias("p"), (-F.col("votes")).alias("n"), choice)).alias("x")
    return counted.groupBy(*keys).agg(best).select(*keys, F.col(f"x.{choice}").alias(choice), (-F.col("x.n")).alias("votes"), (F.col("x.p") == -1).alias("by_primary"))


def majority_by_period(rows: DataFrame, keys: list[str], choice: str, inside: Column, least: int = 2) -> DataFrame:
    """keys, within, elsewhere: the choice of most witnesses inside the period and outside it (the smaller on a tie).

    Fewer than `least` witnesses inside are not trusted: the choice of outside
    stands there too. leaked: the choice inside is also some witness's outside.
    """
    counted = rows.groupBy(*keys, choice).agg(F.count_if(inside).alias("i"), F.count_if(~inside).alias("o"))
    within = F.min(F.when(F.col("i") > 0, F.struct((-F.col("i")).alias("n"), F.col(choice).alias("c"), (F.col("o") > 0).alias("both")))).alias("w")
    elsewhere = F.min(F.when(F.col("o") > 0, F.struct((-F.col("o")).alias("n"), F.col(choice).alias("c")))).alias("e")
    x = counted.groupBy(*keys).agg(within, elsewhere, F.sum("i").alias("n_inside"))
    trusted = F.col("n_inside") >= least
    return x.select(*keys, F.when(trusted, F.col("w.c")).otherwise(F.col("e.c")).alias("within"), F.col("e.c").alias("elsewhere"), (trusted & F.col("w.both")).alias("leaked"))


def all_but_one(rows: DataFrame, keys: list[str], choice: str, least: int = 4) -> DataFrame:
    """keys, choice, n: all witnesses agree, or of `least` and more all but one."""
    counted = rows.groupBy(*keys, choice).agg(F.count(F.lit(1)).alias("__c"))
    x = counted.groupBy(*keys).agg(F.sum("__c").alias("n"), F.max(F.struct("__c", choice)).alias("x"))
    fits = (F.col("x.__c") == F.col("n")) | ((F.col("n") >= least) & (F.col("x.__c") == F.col("n") - 1))
    return x.where(fits).select(*keys, F.col(f"x.{choice}").alias(choice), "n")


def marked_dominance(rows: DataFrame, keys: list[str], choice: str, share: float = 0.8, least: int = 5, unmarked: float = 0.9) -> DataFrame:
    """keys, choice, n, total, decision: `unmarked` (no choice at all in that share of `least` rows or more), `sure`, `conflict`, or `none` without any choice."""
    counted = rows.groupBy(*keys, choice).agg(F.count(F.lit(1)).alias("__c"))
    top = F.min(F.when(F.col(choice).isNotNull(), F.struct((-F.col("__c")).alias("n"), F.col(choice).alias("c")))).alias("x")
    blank = F.coalesce(F.sum(F.when(F.col(choice).isNull(), F.col("__c"))), F.lit(0)).alias("blank")
    x = counted.groupBy(*keys).agg(top, blank, F.sum("__c").alias("total"))
    marked = F.col("total") - F.col("blank")
    decision = F.when((F.col("total") >= least) & (F.col("blank") >= unmarked * F.col("total")), "unmarked").when(marked == 0, "none").when(-F.col("x.n") >= share * marked, "sure").otherwise("conflict")
    return x.select(*keys, F.col("x.c").alias(choice), (-F.col("x.n")).alias("n"), "total", decision.alias("decision"))


def promote_shared(rows: DataFrame, value: str, owner: str) -> DataFrame:
    """value, owner, shared: values with several owners move to the shared group (owner null), once each; others stay with theirs."""
    x = rows.groupBy(value).agg(F.min(owner).alias("lo"), F.max(owner).alias("hi"))
    shared = ~F.col("lo").eqNullSafe(F.col("hi"))
    return x.select(value, F.when(~shared, F.col("lo")).alias(owner), shared.alias("shared"))


def where_cycles_differ(rows: DataFrame, slot: list[str], cycle: str, choice: str) -> DataFrame:
    """slot, cycle, choice by majority in each cycle, only for slots whose cycles came to different choices."""
    counted = rows.groupBy(*slot, cycle, choice).agg(F.count(F.lit(1)).alias("n"))
    each = counted.groupBy(*slot, cycle).agg(F.min(F.struct((-F.col("n")).alias("n"), choice)).alias("x")).select(*slot, cycle, F.col(f"x.{choice}").alias(choice))
    differ = each.groupBy(*slot).agg(F.min(choice).alias("lo"), F.max(choice).alias("hi")).where("lo <> hi").select(*slot)
    return each.join(differ, slot, "left_semi")


def prune_singletons(rows: DataFrame, keys: list[str], choice: str, period: str, least: int = 3) -> DataFrame:
    """keys, choice, n: choices that came up more than once, or any where the key was seen in fewer than `least` periods."""
    counted = rows.groupBy(*keys, choice).agg(F.count(F.lit(1)).alias("n"))
    seen = rows.groupBy(*keys).agg(F.count_distinct(period).alias("periods"))
    return counted.join(seen, keys).where((F.col("n") > 1) | (F.col("periods") < least)).select(*keys, choice, "n")


def stem_analogy(rows: DataFrame, stem: str, answer: str, ratio: int = 2) -> DataFrame:
    """stem, answer, n: the commonest answer of a stem if it is `ratio` times as common as the next."""
    counted = rows.groupBy(stem, answer).agg(F.count(F.lit(1)).alias("n"))
    x = counted.groupBy(stem).agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", answer)))).alias("all"))
    first, second = F.col("all")[0], F.try_element_at(F.col("all"), F.lit(2))
    return x.where(first["n"] >= ratio * F.coalesce(second["n"], F.lit(0))).select(stem, first[answer].alias(answer), first["n"].alias("n"))


def unique_join(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """left with the value of its only match in right and `matches`; null where right has none or several."""
    one = right.groupBy(key).agg(F.count(F.lit(1)).alias("matches"), F.min(value).alias("__v"))
    x = left.join(one, key, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return x.withColumn(value, F.when(F.col("matches") == 1, F.col("__v"))).drop("__v")


def unanimity_join(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """left with the value that all rows of right with its key share; null where they differ or there are none."""
    agreed = right.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__m")).where(F.col(value) == F.col("__m")).drop("__m")
    return left.join(agreed, key, "left")


def supported_variant(rows: DataFrame, keys: list[str], variant: str, witness: str, supported: DataFrame) -> DataFrame:
    """keys, variant, backed, n: among equally frequent leading variants the one with most witnesses in `supported` (a checked small table), then the smaller.

    A variant with fewer witnesses never wins.
    """
    hit = checked_rules(supported.select(F.col(witness), F.lit(1).alias("__hit")).distinct())
    x = rows.join(hit, witness, "left").groupBy(*keys, variant).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__hit"), F.lit(0)).alias("backed"))
    best = F.min(F.struct((-F.col("n")).alias("n"), (-F.col("backed")).alias("b"), variant)).alias("x")
    return x.groupBy(*keys).agg(best).select(*keys, F.col(f"x.{variant}").alias(variant), (-F.col("x.b")).alias("backed"), (-F.col("x.n")).alias("n"))
