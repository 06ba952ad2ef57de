"""Calendars: movable dates, periods, precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import dates
from loomwright.operators import ranges
from loomwright.plans.corpora import _table


def easter_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Easter, the feasts that hang on it, and Advent of 1900 to 2100."""
    years = spark.range(1900, 2101).select(F.col("id").cast("int").alias("year"))
    x = years.withColumn("easter", dates.easter("year"))
    shifted = {"ashes": -46, "ascension": 39, "pentecost": 49}
    return x.select("year", "easter", *[F.date_add("easter", n).alias(c) for c, n in shifted.items()], dates.first_advent("year").alias("advent"))


EASTER_SQL = """
with y as (select cast(range as integer) as year from range(1900, 2101)),
a as (select year, year % 19 as a, year // 100 as b, year % 100 as c from y),
h as (select *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 as h from a),
l as (select *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 as l from h),
e as (select year, make_date(year, 3, 22) + cast(h + l - 7 * ((a + 11 * h + 22 * l) // 451) as integer) as easter from l)
select year, easter, easter - 46 as ashes, easter + 39 as ascension, easter + 49 as pentecost,
  make_date(year, 12, 24) - cast(dayofweek(make_date(year, 12, 24)) as integer) - 21 as advent from e
"""


def asof_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders counted by the church year's period in which they fall."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    ends = orders.agg(F.min(F.year("day")).alias("a"), F.max(F.year("day")).alias("b")).first()
    years = spark.range((ends.a or 1) - 1, (ends.b or 1) + 1).select(F.col("id").cast("int").alias("year"))
    easter = years.withColumn("e", dates.easter("year"))
    starts = easter.select(F.explode(F.array(F.struct(F.date_sub("e", 46).alias("start"), F.lit("lent").alias("period")), F.struct(F.col("e").alias("start"), F.lit("easter").alias("period")), F.struct(F.date_add("e", 50).alias("start"), F.lit("ordinary").alias("period")), F.struct(dates.first_advent("year").alias("start"), F.lit("advent").alias("period")))).alias("x")).select("x.*")
    x = ranges.as_of(orders, "day", starts.coalesce(1), "start")
    return x.groupBy("period", "start").agg(F.count(F.lit(1)).alias("orders"), F.min("day").alias("first_day"))


ASOF_SQL = f"""
with all_years as ({EASTER_SQL}), cal as (select * from all_years where year between (select min(year(o_orderdate)) - 1 from orders) and (select max(year(o_orderdate)) from orders)),
starts as (select ashes as start, 'lent' as period from cal union all select easter, 'easter' from cal
  union all select easter + 50, 'ordinary' from cal union all select advent, 'advent' from cal)
select period, start, count(*) as orders, min(day) as first_day
from (select cast(o_orderdate as date) as day from orders) o asof left join starts s on o.day >= s.start group by all
"""


def precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order that ranks first on each day by priority, price and key, how many give way, and whether the next day's outranks it."""
    from pyspark.sql.window import Window

    rows = _table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"), "o_totalprice", "o_orderkey")
    top = rows.groupBy("day").agg(F.min(F.struct("rank", (-F.col("o_totalprice")).alias("price"), "o_orderkey")).alias("x"), (F.count(F.lit(1)) - 1).alias("omitted")).select("day", "x.rank", "x.o_orderkey", "omitted")
    # one row a day: the months deal the days out, the first day of the next month comes along
    months = top.select(F.explode(F.array(F.trunc("day", "month"), F.trunc(F.date_sub("day", 1), "month"))).alias("month"), "*").distinct()
    after = F.lead("rank").over(Window.partitionBy("month").orderBy("day"))
    next_day = F.lead("day").over(Window.partitionBy("month").orderBy("day"))
    x = months.withColumn("next_rank", F.when(next_day == F.date_add("day", 1), after))
    return x.where(F.col("month") == F.trunc("day", "month")).select("day", "rank", "o_orderkey", "omitted", F.coalesce(F.col("next_rank") < F.col("rank"), F.lit(False)).alias("yields"))


PRECEDENCE_SQL = """
with r as (select cast(o_orderdate as date) as day, cast(substr(o_orderpriority, 1, 1) as integer) as rank, o_totalprice, o_orderkey from orders),
t as (select day, min(rank) as rank, arg_min(o_orderkey, row(rank, -o_totalprice, o_orderkey)) as o_orderkey, count(*) - 1 as omitted from r group by 1)
select t.day, t.rank, t.o_orderkey, t.omitted, coalesce(n.rank < t.rank, false) as yields from t left join t n on n.day = t.day + 1
"""

QUERIES = {"easter_calendar": easter_calendar, "asof_period": asof_period, "precedence": precedence}
SQL = {"easter_calendar": EASTER_SQL, "asof_period": ASOF_SQL, "precedence": PRECEDENCE_SQL}
