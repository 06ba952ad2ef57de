"""One-to-one bridges between two lists of dated names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text
from loomwright.operators import bridging
from loomwright.plans.corpora import _table


def bridge_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's filled orders and the other order that each may stand for, by date and priority, no order twice."""
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus", F.array_distinct(text.words(F.col("o_orderpriority"))).alias("words"))
    filled = orders.where("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "filled")
    other = orders.where("o_orderstatus <> 'F'").withColumnRenamed("o_orderkey", "other")
    return bridging.bridge_once(filled, other, "o_custkey", "filled", "other", "day", "words", 30).select("o_custkey", "filled", "other", "tier", "score")


BRIDGE_SQL = """
with recursive o as (select o_custkey, o_orderkey, cast(o_orderdate as date) as day, o_orderstatus,
    list_distinct(list_filter(string_split(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')) as w from orders),
l as (select * from o where o_orderstatus = 'F'), r as (select *, count(*) over (partition by o_custkey, day) as same from o where o_orderstatus <> 'F'),
m as (select l.o_custkey, l.day, l.o_orderkey as filled, r.o_orderkey as other, len(list_intersect(l.w, r.w)) / least(len(l.w), len(r.w))::double as score, l.day = r.day as same_day, same
  from l join r on l.o_custkey = r.o_custkey and abs(l.day - r.day) <= 30),
c as (select *, case when same_day and score >= 0.2 then 0 when not same_day and score >= 0.5 then 1 when same_day and same = 1 then 2 end as tier from m),
k as (select o_custkey, filled, list(other order by tier, -score, other) as others, row_number() over (partition by o_custkey order by day, filled) as k from c where tier is not null group by o_custkey, day, filled),
walk as (
  select o_custkey, 0::bigint as k, cast([] as bigint[]) as used, cast(null as bigint) as filled, cast(null as bigint) as other from (select distinct o_custkey from k)
  union all
  select o_custkey, k, case when pick is null then used else list_append(used, pick) end, filled, pick from (
    select k.o_custkey, k.k, used, k.filled, list_filter(others, lambda x: not list_contains(used, x))[1] as pick from walk w join k on k.o_custkey = w.o_custkey and k.k = w.k + 1))
select w.o_custkey, w.filled, w.other, tier, score from walk w join c on c.filled = w.filled and c.other = w.other
"""

QUERIES = {"bridge_once": bridge_once}
SQL = {"bridge_once": BRIDGE_SQL}
