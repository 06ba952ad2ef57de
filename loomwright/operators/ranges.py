"""Joins of rows with ranges: first matching rule, expansion, as-of periods, brackets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rules that may be broadcast; a rule table is written by hand, more than this is an error.
RULE_LIMIT = 100_000


def checked_rules(rules: DataFrame, limit: int = RULE_LIMIT) -> DataFrame:
    """A broadcast hint for a rule table, after counting it."""
    n = rules.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"a rule table has at most {limit} rows")
    return F.broadcast(rules)


def renumber(rows: DataFrame, rules: DataFrame, group: str, number: str) -> DataFrame:
    """rows with new_group and new_number by the first rule whose range holds the number; without one, as they were.

    rules: rule_order, group, low, high, new_group, shift, extra. A rule with
    extra > 0 yields extra further numbers. The winner is picked on the map
    side from an array of all rules of a group, so rows are never shuffled.
    """
    rules = checked_rules(rules)  # all rules are counted, not the groups
    by_group = rules.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("rule_order", "low", "high", "new_group", "shift", "extra"))).alias("rules"))
    x = rows.join(F.broadcast(by_group), F.col(group) == F.col("group"), "left")
    hit = F.filter("rules", lambda r: (F.col(number) >= r["low"]) & (F.col(number) <= r["high"]))
    x = x.withColumn("rule", F.try_element_at(hit, F.lit(1)))
    x = x.withColumn("first", F.col(number) + F.coalesce("rule.shift", F.lit(0)))
    x = x.withColumn("new_number", F.explode(F.sequence("first", F.col("first") + F.coalesce("rule.extra", F.lit(0)))))
    return x.withColumn("new_group", F.coalesce("rule.new_group", group)).drop("group", "rules", "rule", "first")


def expand(rows: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """One row for each number of a closed range; none for an empty one."""
    return rows.where(F.col(low) <= F.col(high)).withColumn(name, F.explode(F.sequence(low, high)))


def as_of(rows: DataFrame, at: str, periods: DataFrame, start: str) -> DataFrame:
    """rows with the columns of the last period whose start isn't after `at` (null before the first).

    periods are a checked small table. Rows and starts meet by the year: a
    period is listed under its own year and all years up to the next start, so
    the join is an equi-join with a broadcast side and few candidates a row.
    Starts are dates or times, each once.
    """
    known = checked_rules(periods.where(F.col(start).isNotNull()))
    last = rows.agg(F.max(F.year(at))).first()[0]
    ends = known.withColumn("__next", F.lead(start).over(Window.orderBy(start)))
    years = F.sequence(F.year(start), F.greatest(F.year(start), F.coalesce(F.year("__next"), F.lit(last or 0))))
    listed = ends.withColumn("__year", F.explode(years))
    inside = (F.year(at) == F.col("__year")) & (F.col(at) >= F.col(start)) & (F.col("__next").isNull() | (F.col(at) < F.col("__next")))
    return rows.join(F.broadcast(listed), inside, "left").drop("__next", "__year")


def bracket(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """rows with `before` and `after`: the nearest non-null values of the same key on either side."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("before", before).withColumn("after", after)
