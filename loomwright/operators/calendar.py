"""Calendars made from rules: keys of days, precedence among what falls on a day, near dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions import dates


def year_days(years: DataFrame, year: str = "year") -> DataFrame:
    """A row a day of each liturgical year (it begins with Advent of the year before): year, day, season, week, dow (1 Sunday), sunday_letter, ferial.

    Ordinary weeks before Lent count from the Sunday on or before 13 January
    (the Baptism's), those after Pentecost back from the 34th, the week before
    Advent. Season boundaries are the days themselves.
    """
    last, this = f"({year} - 1)", year
    x = years.select(year, dates.first_advent(last).alias("advent"), dates.easter(this).alias("easter"), dates.first_advent(this).alias("next"))
    x = x.withColumn("baptism", dates.sunday_on_or_before(F.expr(f"make_date({year}, 1, 13)")))
    x = x.withColumn("day", F.explode(F.sequence("advent", F.date_sub("next", 1))))
    day, anchor = F.col("day"), dates.sunday_on_or_before(F.col("day"))
    christmas = F.expr(f"make_date({last}, 12, 25)")
    season = (
        F.when(day < christmas, "advent").when(day <= F.col("baptism"), "christmas").when(day < F.date_sub("easter", 46), "ordinary")
        .when(day < F.date_sub("easter", 3), "lent").when(day < F.col("easter"), "triduum").when(day <= F.date_add("easter", 49), "easter").otherwise("ordinary")
    )
    weeks = lambda a, b: (F.datediff(a, b) / 7).cast("int")
    number = (
        F.when(F.col("season") == "advent", weeks(anchor, F.col("advent")) + 1)
        .when((F.col("season") == "ordinary") & (day < F.col("easter")), weeks(anchor, F.col("baptism")) + 1)
        .when(F.col("season") == "ordinary", 34 - weeks(F.date_sub("next", 7), anchor))
        .when(F.col("season") == "lent", weeks(anchor, F.date_sub("easter", 42)) + 1)
        .when(F.col("season") == "easter", weeks(anchor, F.col("easter")) + 1)
    )
    x = x.withColumn("season", season)
    week = F.when((F.col("season") == "lent") & (day < F.date_sub("easter", 42)), 0).otherwise(number)
    letter = F.element_at(F.array(F.lit("C"), F.lit("A"), F.lit("B")), (F.col(year) % 3 + 1).cast("int"))
    ferial = F.when(F.col(year) % 2 == 1, "I").otherwise("II")
    return x.select(year, "day", "season", week.alias("week"), F.dayofweek("day").alias("dow"), letter.alias("sunday_letter"), ferial.alias("ferial"))


def nearest_weekday(date: Column, weekday: Column) -> Column:
    """The date of that weekday (1 Sunday) within the month of `date` that is nearest to it, the earlier on a tie."""
    back = F.pmod(F.dayofweek(date) - weekday, F.lit(7))
    before, after = F.date_sub(date, back), F.date_add(date, (7 - back) % 7)
    outside = lambda d: F.trunc(d, "month") != F.trunc(date, "month")
    return F.when(outside(before), after).when(outside(after), before).when(back <= (7 - back) % 7, before).otherwise(after)


def spelled_date(x: Column, months: list[str], year: Column) -> Column:
    """ "3 de mayo", "mayo 3", "3 mayo" with the given month names -> date; null if none is found or there is no such day."""
    month = F.array_position(F.array(*[F.lit(m) for m in months]), F.regexp_extract(F.lower(x), rf"({'|'.join(months)})", 1))
    day = F.regexp_extract(x, r"(\d{1,2})", 1).try_cast("int")
    text = F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when((month > 0) & day.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def precedence(items: DataFrame, day: str, rank: str, temporal: str, movable: str, lent: str, order: str) -> DataFrame:
    """items that are kept on their day, with new_rank, not_celebrated, optional and place (their order on the day).

    t is the day's least rank. Two or more sanctoral items of rank 10 where t
    is 10 or more become rank 12, as does one that meets a Lent weekday; a
    movable one of them comes before its like. Kept: ranks up to t; temporal
    items, not celebrated where t <= 9; where t = 9 also ranks from 10 on, as
    optional; where t >= 10 ranks from 10 on. Days hold few items each.
    """
    r, is_temporal = F.col(rank), F.col(temporal)
    ten = ~is_temporal & (r == 10)
    by_day = items.groupBy(day).agg(F.min(r).alias("__t"), F.count_if(ten).alias("__tens"), F.max(F.col(lent).cast("int")).alias("__lent"))
    x = items.join(by_day, day)
    t = F.col("__t")
    crowded = (F.col("__tens") >= 2) & (t >= 10) & ten
    demoted = crowded | (ten & (F.col("__lent") == 1))
    x = x.withColumn("new_rank", F.when(demoted, 12).otherwise(r)).withColumn("__order", F.when(crowded & F.col(movable), -1).otherwise(F.col(order)))
    n = F.col("new_rank")
    x = x.withColumn("not_celebrated", is_temporal & (n > t) & (t <= 9)).withColumn("optional", ~is_temporal & (n > t) & (t == 9) & (n >= 10))
    kept = (n <= t) | is_temporal | ((t == 9) & (n >= 10)) | ((t >= 10) & (n >= 10))
    place = F.row_number().over(Window.partitionBy(day).orderBy("not_celebrated", "new_rank", temporal, "__order", order))
    return x.where(kept).withColumn("place", place).drop("__t", "__tens", "__lent", "__order")


#: Sets of so many words meet by their subsets, at most 2 ** SMALL_SET a row; larger ones by their words.
SMALL_SET = 5


def _subsets(words: Column) -> Column:
    """All subsets with a member, of an array in order."""
    return F.filter(F.aggregate(words, F.array(F.array().cast("array<string>")), lambda s, w: F.concat(s, F.transform(s, lambda p: F.array_append(p, w)))), lambda p: F.size(p) > 0)


def near_date_names(left: DataFrame, right: DataFrame, left_id: str, right_id: str, date: str, tokens: str, links: DataFrame, reach: int = 1) -> DataFrame:
    """left_id, right_id, shared, offset: for each left row the right row within `reach` days that shares most words; the nearer, then the earlier date, then the smaller id on a tie.

    links (left_id, right_id; few) go before all else. Rows that share no word
    with any near one have no match and are left out. A right row may serve several.
    """
    # rows of one date and one set of words have one match, the smallest id of such right rows
    mine = left.select(left_id, F.col(date).alias("__day"), F.array_sort(F.array_distinct(tokens)).alias("__set"))
    asked = mine.where(F.size("__set") > 0).groupBy("__day", "__set").agg(F.count(F.lit(1)))
    theirs = right.select(right_id, F.col(date).alias("__at"), F.array_sort(F.array_distinct(tokens)).alias("__set")).where(F.size("__set") > 0).groupBy("__at", "__set").agg(F.min(right_id).alias(right_id))
    near = asked.withColumn("offset", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("__at", F.expr("date_add(__day, offset)"))
    order = lambda n: F.struct((-n).alias("n"), F.abs("offset").alias("far"), "offset", right_id)
    small = F.size("__set") <= SMALL_SET
    # two sets share n words if and only if a subset of n words is of both, so each meets its best where the largest subset does
    part = lambda x: x.where(small).withColumn("__part", F.explode(_subsets(F.col("__set"))))
    parts = part(theirs).groupBy("__at", "__part").agg(F.min(right_id).alias(right_id))
    by_part = part(near).join(parts, ["__at", "__part"]).groupBy("__day", "__set").agg(F.min(order(F.size("__part").cast("long"))).alias("x"))
    # sets of many words meet by their words, those of few only where the other has many
    words = lambda x, kept: x.where(kept).withColumn("__w", F.explode("__set"))
    others = lambda kept: words(theirs, kept).select(F.col("__set").alias("__other"), right_id, "__at", "__w")
    met = words(near, ~small).join(others(F.lit(True)), ["__at", "__w"]).unionByName(words(near, small).join(others(~small), ["__at", "__w"]))
    counted = met.groupBy("__day", "__set", "offset", "__other", right_id).agg(F.count(F.lit(1)).alias("shared"))
    by_word = counted.groupBy("__day", "__set").agg(F.min(order(F.col("shared"))).alias("x"))
    best = by_part.unionByName(by_word).groupBy("__day", "__set").agg(F.min("x").alias("x"))
    best = mine.join(best, ["__day", "__set"]).groupBy(left_id).agg(F.min("x").alias("x"))
    best = best.select(left_id, F.col(f"x.{right_id}").alias("__found"), (-F.col("x.n")).alias("shared"), "x.offset")
    fixed = links.select(left_id, F.col(right_id).alias("__link"))
    x = best.join(fixed, left_id, "full_outer")
    manual = F.col("__link").isNotNull()
    return x.select(left_id, F.coalesce("__link", "__found").alias(right_id), F.when(~manual, F.col("shared")).alias("shared"), F.when(~manual, F.col("offset")).alias("offset"))


def best_shift(asked: DataFrame, present: DataFrame, keys: list[str], number: str, reach: int, margin: int) -> DataFrame:
    """keys, shift, found, unshifted: the shift of a key's numbers by which most are present, if it gains `margin` on none; else 0. The smaller shift on a tie."""
    x = asked.withColumn("shift", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn(number, F.col(number) + F.col("shift"))
    hits = x.join(present.select(*keys, number).distinct().withColumn("__hit", F.lit(1)), [*keys, number], "left")
    found = hits.groupBy(*keys, "shift").agg(F.count("__hit").alias("found"))
    best = F.min(F.struct((-F.col("found")).alias("n"), F.abs("shift").alias("far"), "shift")).alias("x")
    y = found.groupBy(*keys).agg(best, F.max(F.when(F.col("shift") == 0, F.col("found"))).alias("unshifted"))
    gain = (-F.col("x.n") - F.col("unshifted")) >= margin
    return y.select(*keys, F.when(gain, F.col("x.shift")).otherwise(0).alias("shift"), F.when(gain, -F.col("x.n")).otherwise(F.col("unshifted")).alias("found"), "unshifted")


def select_form(forms: DataFrame, keys: list[str], label: str, letter: Column, ferial: Column, place: str) -> DataFrame:
    """keys and the columns of one form each: the label that is the Sunday letter, else one that begins with the ferial year, else one that names several letters, else one that begins with the letter, else the first."""
    tier = F.when(F.col(label) == letter, 0).when(F.startswith(F.col(label), F.concat(ferial, F.lit("-"))), 1).when(F.col(label).rlike("^[ABC](/[ABC])+$"), 2).when(F.startswith(F.col(label), letter), 3).otherwise(4)
    rest = [c for c in forms.columns if c not in keys and c not in (label, place)]
    best = F.min(F.struct(tier.alias("tier"), F.col(place).alias("place"), F.col(label).alias("label"), *rest)).alias("x")
    return forms.groupBy(*keys).agg(best).select(*keys, F.col("x.label").alias(label), F.col("x.tier").alias("tier"), *[f"x.{c}" for c in rest])
