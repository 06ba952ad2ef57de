"""Queries of the calendar operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import calendar
from loomwright.plans.calendars import EASTER_SQL
from loomwright.plans.corpora import _table


def year_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season, week and cycle of every day of the liturgical years 1990 to 2060."""
    return calendar.year_days(spark.range(1990, 2061).select(F.col("id").cast("int").alias("year")))


YEAR_SQL = f"""
with cal as ({EASTER_SQL}),
y as (select t.year, l.advent, t.easter, t.advent as next, make_date(t.year, 1, 13) - cast(dayofweek(make_date(t.year, 1, 13)) as integer) as baptism from cal t join cal l on l.year = t.year - 1 where t.year between 1990 and 2060),
d as (select *, cast(unnest(generate_series(advent::timestamp, next::timestamp - interval 1 day, interval 1 day)) as date) as day from y),
s as (select *, day - cast(dayofweek(day) as integer) as anchor, case when day < make_date(year - 1, 12, 25) then 'advent' when day <= baptism then 'christmas' when day < easter - 46 then 'ordinary' when day < easter - 3 then 'lent' when day < easter then 'triduum' when day <= easter + 49 then 'easter' else 'ordinary' end as season from d)
select year, day, season, cast(case when season = 'advent' then (anchor - advent) // 7 + 1 when season = 'ordinary' and day < easter then (anchor - baptism) // 7 + 1 when season = 'ordinary' then 34 - (next - 7 - anchor) // 7
    when season = 'lent' and day < easter - 42 then 0 when season = 'lent' then (anchor - easter + 42) // 7 + 1 when season = 'easter' then (anchor - easter) // 7 + 1 end as integer) as week,
  cast(dayofweek(day) + 1 as integer) as dow, ['C', 'A', 'B'][year % 3 + 1] as sunday_letter, case when year % 2 = 1 then 'I' else 'II' end as ferial from s
"""


def full_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as celebrations of their day, ranked by key: which are kept, how, and in what order."""
    x = _table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderkey", (F.col("o_orderkey") % 13 + 1).cast("int").alias("rank"), (F.col("o_orderkey") % 5 == 0).alias("temporal"), (F.col("o_custkey") % 4 == 0).alias("movable"))
    x = x.withColumn("lent", F.col("temporal") & (F.col("rank") == 13))
    return calendar.precedence(x, "day", "rank", "temporal", "movable", "lent", "o_orderkey").select("day", "o_orderkey", "new_rank", "not_celebrated", "optional", F.col("place").cast("long").alias("place"))


FULL_PRECEDENCE_SQL = """
with i as (select cast(o_orderdate as date) as day, o_orderkey, cast(o_orderkey % 13 + 1 as integer) as rank, o_orderkey % 5 = 0 as temporal, o_custkey % 4 = 0 as movable from orders),
w as (select *, min(rank) over (partition by day) as t, count(*) filter (where not temporal and rank = 10) over (partition by day) as tens, bool_or(temporal and rank = 13) over (partition by day) as lent from i),
n as (select *, not temporal and rank = 10 and tens >= 2 and t >= 10 as crowded from w),
m as (select *, case when crowded or (not temporal and rank = 10 and lent) then 12 else rank end as new_rank, case when crowded and movable then -1 else o_orderkey end as o from n),
k as (select *, temporal and new_rank > t and t <= 9 as not_celebrated, not temporal and new_rank > t and t = 9 and new_rank >= 10 as optional from m where new_rank <= t or temporal or (t = 9 and new_rank >= 10) or (t >= 10 and new_rank >= 10))
select day, o_orderkey, new_rank, not_celebrated, optional, row_number() over (partition by day order by not_celebrated, new_rank, temporal, o, o_orderkey) as place from k
"""


def near_date_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pending order with the finished one within a day that shares most of segment, nation and priority with it; two links are given."""
    who = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    x = _table(spark, sf_dir, "orders").join(who, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus", F.array(F.lower("c_mktsegment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.lower("o_orderpriority")).alias("tokens"))
    links = spark.sql("select * from values (1L, 2L), (3L, 5L) as t(o_orderkey, other)")
    right = x.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("other"), "day", "tokens")
    return calendar.near_date_names(x.where("o_orderstatus = 'P'"), right, "o_orderkey", "other", "day", "tokens", links).select("o_orderkey", "other", "shared", "offset")


NEAR_SQL = """
with x as (select o_orderkey, cast(o_orderdate as date) as day, o_orderstatus, list_distinct([lower(c_mktsegment), 'n' || c_nationkey, lower(o_orderpriority)]) as w from orders join customer on o_custkey = c_custkey),
p as (select a.o_orderkey, b.o_orderkey as other, len(list_intersect(a.w, b.w)) as shared, cast(b.day - a.day as integer) as o from x a join x b on b.day between a.day - 1 and a.day + 1 where a.o_orderstatus = 'P' and b.o_orderstatus = 'F'),
r as (select * from (select *, row_number() over (partition by o_orderkey order by shared desc, abs(o), o, other) as k from p where shared > 0) where k = 1),
l as (select * from (values (1::bigint, 2::bigint), (3, 5)) t(o_orderkey, link))
select coalesce(r.o_orderkey, l.o_orderkey) as o_orderkey, coalesce(link, other) as other, case when link is null then shared end as shared, case when link is null then o end as "offset" from r full join l on l.o_orderkey = r.o_orderkey
"""


def weekday_and_spelled_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the nearest date of a weekday in its month, and its date spelled out and read back."""
    months = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
    x = _table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    name = F.element_at(F.array(*[F.lit(m) for m in months]), F.month("day"))
    spelled = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.dayofmonth("day").cast("string"), F.lit(" de "), name)).when(F.col("o_orderkey") % 3 == 1, F.concat(name, F.lit(" "), F.dayofmonth("day").cast("string"))).otherwise(F.concat(F.lit("31 de "), name))
    x = x.withColumn("read", calendar.spelled_date(spelled, months, F.year("day")))
    return x.select("o_orderkey", calendar.nearest_weekday(F.col("day"), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("near"), "read")


WEEKDAY_SQL = """
with x as (select o_orderkey, cast(o_orderdate as date) as day from orders),
d as (select *, unnest(range(-6, 7)) as o from x),
n as (select o_orderkey, arg_min(day + cast(o as integer), row(abs(o), o)) as near from d where dayofweek(day + cast(o as integer)) = o_orderkey % 7 and month(day + cast(o as integer)) = month(day) group by 1)
select x.o_orderkey, near, case when x.o_orderkey % 3 < 2 then day when day(last_day(day)) = 31 then last_day(day) end as read from x join n on n.o_orderkey = x.o_orderkey
"""


def offset_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By what shift an order's supplier numbers meet those of the order before best, if that gains two."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 12).alias("n")).distinct()
    return calendar.best_shift(lines, lines.withColumn("l_orderkey", F.col("l_orderkey") + 1), ["l_orderkey"], "n", 3, 2).select("l_orderkey", F.col("shift").cast("int").alias("shift"), "found", "unshifted")


OFFSET_SQL = """
with l as (select distinct l_orderkey, l_suppkey % 12 as n from lineitem), a as (select *, unnest(range(-3, 4)) as s from l),
f as (select a.l_orderkey, s, count(b.n) as f from a left join l b on b.l_orderkey = a.l_orderkey - 1 and b.n = a.n + s group by 1, 2),
g as (select l_orderkey, arg_min(s, row(-f, abs(s), s)) as s, max(f) as f, max(f) filter (where s = 0) as u from f group by 1)
select l_orderkey, cast(case when f - u >= 2 then s else 0 end as integer) as shift, case when f - u >= 2 then f else u end as found, u as unshifted from g
"""


def form_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of each order's lines as the form for its year's letters, by labels made of quantity and line number."""
    x = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y")), F.col("l_orderkey") == F.col("o_orderkey"))
    label = F.element_at(F.array(*[F.lit(s) for s in ("A", "B", "C", "I-x", "II-x", "A/B", "B/C", "A*", "B*", "C*", "")]), (F.col("l_quantity").cast("int") % 11 + 1))
    x = x.select("l_orderkey", label.alias("label"), F.col("l_linenumber").alias("place"), "l_partkey", F.element_at(F.array(F.lit("C"), F.lit("A"), F.lit("B")), F.col("y") % 3 + 1).alias("letter"), F.when(F.col("y") % 2 == 1, "I").otherwise("II").alias("ferial"))
    done = calendar.select_form(x, ["l_orderkey"], "label", F.col("letter"), F.col("ferial"), "place")
    return done.select("l_orderkey", "label", "tier", "l_partkey")


FORM_SELECTION_SQL = """
with x as (select l_orderkey, ['A', 'B', 'C', 'I-x', 'II-x', 'A/B', 'B/C', 'A*', 'B*', 'C*', ''][cast(l_quantity as int) % 11 + 1] as label, l_linenumber as place, l_partkey, ['C', 'A', 'B'][year(o_orderdate) % 3 + 1] as c, case when year(o_orderdate) % 2 = 1 then 'I' else 'II' end as f from lineitem join orders on l_orderkey = o_orderkey),
t as (select *, case when label = c then 0 when starts_with(label, f || '-') then 1 when regexp_matches(label, '^[ABC](/[ABC])+$') then 2 when starts_with(label, c) then 3 else 4 end as tier from x)
select l_orderkey, label, tier, l_partkey from (select *, row_number() over (partition by l_orderkey order by tier, place, label, l_partkey) as k from t) where k = 1
"""

QUERIES = {"year_generator": year_generator, "full_precedence": full_precedence, "near_date_names": near_date_names, "weekday_and_spelled_dates": weekday_and_spelled_dates, "offset_search": offset_search, "form_selection": form_selection}
SQL = {"year_generator": YEAR_SQL, "full_precedence": FULL_PRECEDENCE_SQL, "near_date_names": NEAR_SQL, "weekday_and_spelled_dates": WEEKDAY_SQL, "offset_search": OFFSET_SQL, "form_selection": FORM_SELECTION_SQL}
