"""Queries of the consensus operators over events: users are witnesses, hours and days are slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import consensus
from loomwright.plans.corpora import _table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _table(spark, sf_dir, "events")
    return x.select("event_id", "user_id", "event_type", "value", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("dom"))


_BASE = "select event_id, user_id, event_type, value, cast(ts as date) as day, cast(hour(ts) as int) as hour, cast(month(ts) as int) as month, cast(day(ts) as int) as dom from events"


def priority_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event type of each day and hour: what a user with a key below five did comes first."""
    return consensus.majority_with_priority(_events(spark, sf_dir), ["day", "hour"], "event_type", F.col("user_id") < 5)


PRIORITY_SQL = f"""
with e as ({_BASE}), c as (select day, hour, event_type, count(*) as votes, max(case when user_id < 5 then 1 else 0 end) as p from e group by all),
r as (select *, row_number() over (partition by day, hour order by p desc, votes desc, event_type) as k from c)
select day, hour, event_type, votes, p = 1 as by_primary from r where k = 1
"""


def period_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's commonest event type in the morning and in the rest of the day."""
    return consensus.majority_by_period(_events(spark, sf_dir), ["user_id"], "event_type", F.col("hour") < 6, 3)


PERIOD_SQL = f"""
with e as ({_BASE}), c as (select user_id, event_type, count(*) filter (where hour < 6) as i, count(*) filter (where hour >= 6) as o from e group by all),
w as (select user_id, event_type, o from (select *, row_number() over (partition by user_id order by i desc, event_type) as k from c where i > 0) where k = 1),
s as (select user_id, event_type from (select *, row_number() over (partition by user_id order by o desc, event_type) as k from c where o > 0) where k = 1),
t as (select user_id, sum(i) as n from c group by 1)
select t.user_id, case when n >= 3 then w.event_type else s.event_type end as within, s.event_type as elsewhere, n >= 3 and w.o > 0 as leaked
from t left join w on w.user_id = t.user_id left join s on s.user_id = t.user_id
"""


def all_but_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and hours of whose events all, or all but one, are of one type."""
    return consensus.all_but_one(_events(spark, sf_dir), ["user_id", "hour"], "event_type")


ALL_BUT_ONE_SQL = f"""
with e as ({_BASE}), c as (select user_id, hour, event_type, count(*) as c from e group by all),
t as (select user_id, hour, cast(sum(c) as bigint) as n, arg_max(event_type, row(c, event_type)) as event_type, max(c) as m from c group by 1, 2)
select user_id, hour, event_type, n from t where m = n or (n >= 4 and m = n - 1)
"""


def marked_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type that dominates a user's events; views count as no mark."""
    x = _events(spark, sf_dir).withColumn("event_type", F.when(F.col("event_type") != "view", F.col("event_type")))
    return consensus.marked_dominance(x, ["user_id"], "event_type", 0.5, 5, 0.4)


MARKED_SQL = f"""
with e as (select user_id, nullif(event_type, 'view') as event_type from ({_BASE})),
c as (select user_id, event_type, count(*) as c from e group by all),
b as (select user_id, event_type, c from (select *, row_number() over (partition by user_id order by c desc, event_type) as k from c where event_type is not null) where k = 1),
t as (select user_id, cast(sum(c) as bigint) as total, cast(coalesce(sum(c) filter (where event_type is null), 0) as bigint) as blank from c group by 1)
select t.user_id, b.event_type, b.c as n, total, case when total >= 5 and blank >= 0.4 * total then 'unmarked' when total = blank then 'none' when b.c >= 0.5 * (total - blank) then 'sure' else 'conflict' end as decision
from t left join b on b.user_id = t.user_id
"""


def promoted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that one supplier delivers stay with it, those of several go to the shared group."""
    return consensus.promote_shared(_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")


PROMOTED_SQL = "select l_partkey, case when count(distinct l_suppkey) = 1 then min(l_suppkey) end as l_suppkey, count(distinct l_suppkey) > 1 as shared from lineitem group by 1"


def cycle_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the month and hours whose commonest event type isn't the same in all thirds of the users."""
    return consensus.where_cycles_differ(_events(spark, sf_dir).withColumn("cycle", F.col("user_id") % 3), ["dom", "hour"], "cycle", "event_type")


CYCLE_SQL = f"""
with e as ({_BASE}), c as (select dom, hour, user_id % 3 as cycle, event_type, count(*) as n from e group by all),
r as (select dom, hour, cycle, arg_min(event_type, row(-n, event_type)) as event_type from c group by 1, 2, 3)
select * from r a where exists (select 1 from r b where b.dom = a.dom and b.hour = a.hour and b.event_type <> a.event_type)
"""


def pruned_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's event types by hour, without those seen once where the hour was seen on three days or more."""
    return consensus.prune_singletons(_events(spark, sf_dir), ["user_id", "hour"], "event_type", "day")


SINGLETON_SQL = f"""
with e as ({_BASE}), c as (select user_id, hour, event_type, count(*) as n from e group by all), d as (select user_id, hour, count(distinct day) as p from e group by all)
select c.user_id, c.hour, event_type, n from c join d on d.user_id = c.user_id and d.hour = c.hour where n > 1 or p < 3
"""


def stem_analogy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The return flag of each part's lines, where it is at least twice as common as the next."""
    x = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("stem"), F.col("l_returnflag").alias("answer"))
    return consensus.stem_analogy(x, "stem", "answer")


STEM_SQL = """
with c as (select l_partkey as stem, l_returnflag as answer, count(*) as n from lineitem group by all),
r as (select *, row_number() over (partition by stem order by n desc, answer desc) as k, lead(n) over (partition by stem order by n desc, answer desc) as m from c)
select stem, answer, n from r where k = 1 and n >= 2 * coalesce(m, 0)
"""


def lone_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their urgent order if they have just one, and the status that all their orders share."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    x = _table(spark, sf_dir, "customer").select("c_custkey")
    x = consensus.unique_join(x, orders.where("o_orderpriority = '1-URGENT'"), "c_custkey", "o_orderkey")
    return consensus.unanimity_join(x, orders, "c_custkey", "o_orderstatus")


LONE_SQL = """
with u as (select o_custkey, count(*) as matches, min(o_orderkey) as k from orders where o_orderpriority = '1-URGENT' group by 1),
s as (select o_custkey, min(o_orderstatus) as o_orderstatus from orders group by 1 having count(distinct o_orderstatus) = 1)
select c_custkey, coalesce(matches, 0) as matches, case when matches = 1 then k end as o_orderkey, o_orderstatus from customer left join u on u.o_custkey = c_custkey left join s on s.o_custkey = c_custkey
"""


def supported_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hour's leading event type of a day; ties go to the one with most users below ten."""
    known = spark.range(10).select(F.col("id").alias("user_id"))
    return consensus.supported_variant(_events(spark, sf_dir), ["day", "hour"], "event_type", "user_id", known)


SUPPORTED_SQL = f"""
with e as ({_BASE}), c as (select day, hour, event_type, count(*) as n, count(*) filter (where user_id between 0 and 9) as backed from e group by all)
select day, hour, event_type, backed, n from (select *, row_number() over (partition by day, hour order by n desc, backed desc, event_type) as k from c) where k = 1
"""

QUERIES = {"priority_majority": priority_majority, "period_majority": period_majority, "all_but_one": all_but_one, "marked_dominance": marked_dominance, "promoted_parts": promoted_parts, "cycle_differences": cycle_differences, "pruned_singletons": pruned_singletons, "stem_analogy": stem_analogy, "lone_match": lone_match, "supported_variants": supported_variants}
SQL = {"priority_majority": PRIORITY_SQL, "period_majority": PERIOD_SQL, "all_but_one": ALL_BUT_ONE_SQL, "marked_dominance": MARKED_SQL, "promoted_parts": PROMOTED_SQL, "cycle_differences": CYCLE_SQL, "pruned_singletons": SINGLETON_SQL, "stem_analogy": STEM_SQL, "lone_match": LONE_SQL, "supported_variants": SUPPORTED_SQL}
