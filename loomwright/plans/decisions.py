"""Votes, dominance, medians, attribution and patches over the events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import patches, ranges, votes
from loomwright.plans.corpora import _table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))


def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event type most seen for each user, ties to the smaller."""
    return votes.majority(_events(spark, sf_dir), ["user_id"], "event_type")


MAJORITY_SQL = """
with c as (select user_id, event_type, count(*) as votes from events group by all)
select user_id, arg_min(event_type, row(-votes, event_type)) as event_type, max(votes) as votes, count(*) as variants,
  count(*) filter (votes = top) > 1 as tied
from (select *, max(votes) over (partition by user_id) as top from c) group by user_id
"""


def dominance_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one order status dominates a customer's orders."""
    return votes.dominance(_table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", 0.6, 5)


DOMINANCE_SQL = """
with c as (select o_custkey, o_orderstatus, count(*) as n from orders group by all),
t as (select o_custkey, arg_min(o_orderstatus, row(-n, o_orderstatus)) as o_orderstatus, max(n) as n, cast(sum(n) as bigint) as total from c group by 1)
select *, case when total < 5 then 'few' when n >= 0.6 * total then 'sure' else 'conflict' end as decision from t
"""


def upper_median_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer, and the upper median of the number of orders over customers of a segment."""
    counted = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    x = _table(spark, sf_dir, "customer").join(counted, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_mktsegment", F.coalesce("orders", F.lit(0)).alias("orders"))
    return votes.upper_median(x, ["c_mktsegment"], "orders")


UPPER_MEDIAN_SQL = """
with x as (select c_mktsegment, count(o_orderkey) as orders from customer left join orders on c_custkey = o_custkey group by c_mktsegment, c_custkey)
select c_mktsegment, count(*) as n, list_sort(list(orders))[count(*) // 2 + 1] as upper_median from x group by 1
"""


def unanimous_first_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose first event of each day is always of one type."""
    first = _events(spark, sf_dir).groupBy("user_id", "day").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("x")).select("user_id", "day", F.col("x.event_type").alias("event_type"))
    return votes.unanimous(first, ["user_id"], "event_type")


UNANIMOUS_SQL = """
with f as (select user_id, cast(ts as date) as day, arg_min(event_type, row(ts, event_id)) as event_type from events group by all)
select user_id, min(event_type) as event_type from f group by 1 having count(distinct event_type) = 1
"""


def attribution_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user that is there on all days, or all but one, on which an event type with a value bin occurs."""
    rows = _events(spark, sf_dir).withColumn("bin", F.floor(F.col("value") / 50).cast("long"))
    return votes.attribution(rows, ["event_type", "bin"], "user_id", "day")


ATTRIBUTION_SQL = """
with p as (select distinct event_type, cast(floor(value / 50) as bigint) as bin, user_id, cast(ts as date) as day from events),
t as (select event_type, bin, count(distinct day) as total from p group by all),
h as (select p.event_type, p.bin, user_id, count(*) as hits, any_value(total) as total from p join t on t.event_type = p.event_type and t.bin is not distinct from p.bin group by all)
select event_type, bin, arg_min(user_id, row(-hits, user_id)) as user_id, max(hits) as hits, any_value(total) as total
from h where hits = total or total >= 4 and hits >= total - 1 group by all
"""


def bracket_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user's event: the nearest large values before and after it."""
    rows = _events(spark, sf_dir).select("event_id", "user_id", "ts", F.when(F.col("value") > 100, F.round(F.col("value"), 6)).alias("large"))
    return ranges.bracket(rows, ["user_id"], ["ts", "event_id"], "large").select("event_id", "before", "after")


BRACKET_SQL = """
with r as (select event_id, user_id, ts, case when value > 100 then round(value, 6) end as large from events)
select event_id,
  last_value(large ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before,
  first_value(large ignore nulls) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) as after
from r
"""


def patch_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the orders' priorities: the patch between them, applied to the first, leaves no difference."""
    base = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"))
    other = base.where("o_orderkey % 11 <> 0").withColumn("p", F.when(F.col("o_orderkey") % 5 == 0, F.lit("changed")).otherwise(F.col("p")))
    patch = patches.diff(base, other, "o_orderkey", "p")
    left = patches.diff(patches.apply(base, [patch], "o_orderkey", "p"), other, "o_orderkey", "p")
    return patch.groupBy("gone").agg(F.count(F.lit(1)).alias("changes")).join(left.agg(F.count(F.lit(1)).alias("left_over")), F.lit(True))


PATCH_SQL = """
select gone, count(*) as changes, cast(0 as bigint) as left_over from (
  select o_orderkey % 11 = 0 as gone from orders where o_orderkey % 11 = 0 or o_orderkey % 5 = 0 and o_orderpriority <> 'changed') group by 1
"""


def fuse_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal text: the least id and the number of copies."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("print"))
    return patches.fuse(rows, ["print"], "doc_id").where("copies > 1").select("doc_id", "copies")


FUSE_SQL = "select min(doc_id) as doc_id, count(*) as copies from documents group by coalesce(text, '') having count(*) > 1"

QUERIES = {"majority_vote": majority_vote, "dominance_decision": dominance_decision, "upper_median_hist": upper_median_hist, "unanimous_first_daily": unanimous_first_daily, "attribution_intersection": attribution_intersection, "bracket_bounds": bracket_bounds, "patch_roundtrip": patch_roundtrip, "fuse_fingerprint": fuse_fingerprint}
SQL = {"majority_vote": MAJORITY_SQL, "dominance_decision": DOMINANCE_SQL, "upper_median_hist": UPPER_MEDIAN_SQL, "unanimous_first_daily": UNANIMOUS_SQL, "attribution_intersection": ATTRIBUTION_SQL, "bracket_bounds": BRACKET_SQL, "patch_roundtrip": PATCH_SQL, "fuse_fingerprint": FUSE_SQL}
