"""Resolution of numbered ranges against a corpus; counts, gaps and crosschecks.

Lineitem stands for the corpus (order: group, line number: number), with one
row for each pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.operators import ranges


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order and line number: the smallest part, supplier and price."""
    rows = _table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")


RULES = "values (1, 0L, 3, 4, 1L, 1, 0), (2, 0L, 4, 7, 0L, 2, 1), (3, 1L, 1, 2, 2L, 0, 1), (4, 2L, 5, 5, 2L, -4, 0), (5, 3L, 1, 9, 3L, 1, 0) as rules(rule_order, group, low, high, new_group, shift, extra)"


def range_rule_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines renumbered by the first rule of their order's class, looked up in the corpus of that class; found and missing by class."""
    corpus = _corpus(spark, sf_dir).withColumn("class", F.col("l_orderkey") % 5)
    asked = ranges.renumber(corpus, spark.sql(f"select * from {RULES}"), "class", "l_linenumber")
    there = corpus.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("found_part"))
    x = asked.join(there, (F.col("l_orderkey") == F.col("o")) & (F.col("new_number") == F.col("n")), "left")
    return x.groupBy("class", "new_group").agg(F.count(F.lit(1)).alias("asked"), F.count("found_part").alias("found"), F.sum("found_part").alias("part_sum"))


RANGE_RULE_SQL = f"""
with rules as (select * from ({RULES.replace('L', '').replace('"group"', 'group').replace('group', 'grp').replace('new_grp', 'new_group').replace(' as rules', ') as rules')}),
corpus as (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, l_orderkey % 5 as class from lineitem group by 1, 2),
ruled as (
  select c.*, r.*, row_number() over (partition by c.l_orderkey, c.l_linenumber order by r.rule_order) as k
  from corpus c left join rules r on r.grp = c.class and c.l_linenumber between r.low and r.high
), asked as (
  select l_orderkey, class, coalesce(new_group, class) as new_group,
    unnest(generate_series(l_linenumber + coalesce(shift, 0), l_linenumber + coalesce(shift, 0) + coalesce(extra, 0))) as new_number
  from ruled where k = 1
)
select a.class, a.new_group, count(*) as asked, count(c.l_partkey) as found, cast(sum(c.l_partkey) as bigint) as part_sum
from asked a left join corpus c on c.l_orderkey = a.l_orderkey and c.l_linenumber = a.new_number group by 1, 2
"""


def span_resolve_open_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's first lines asked for as a span of three, or openly to the end; lines obtained, with declared gaps left out of what is missing."""
    corpus = _corpus(spark, sf_dir)
    spans = _table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise(F.lit(3)).cast("int").alias("last"))
    x = spans.join(corpus, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    inside = F.col("l_linenumber").isNotNull() & (F.col("last").isNull() | (F.col("l_linenumber") <= F.col("last")))
    got = x.groupBy("o_orderkey", "last").agg(F.sum(inside.cast("int")).cast("long").alias("obtained"))
    declared = F.col("o_orderkey") % 7 == 0
    return got.select("o_orderkey", "obtained", F.when(F.col("last").isNull() | declared, F.lit(0)).otherwise(F.col("last") - F.col("obtained")).cast("long").alias("missing"))


SPAN_SQL = """
with corpus as (select distinct l_orderkey, l_linenumber from lineitem),
spans as (select o_orderkey, case when o_orderkey % 3 = 0 then null else 3 end as last from orders),
got as (select o_orderkey, last, count(l_linenumber) filter (last is null or l_linenumber <= last) as obtained
  from spans left join corpus on o_orderkey = l_orderkey group by all)
select o_orderkey, obtained, cast(case when last is null or o_orderkey % 7 = 0 then 0 else last - obtained end as bigint) as missing from got
"""


def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that an order's sequence skips."""
    corpus = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    before = corpus.withColumn("low", F.coalesce(F.lag("l_linenumber").over(w), F.lit(0)) + 1).withColumn("high", F.col("l_linenumber") - 1)
    return ranges.expand(before, "low", "high", "missing").select("l_orderkey", "missing")


GAPS_SQL = """
with c as (select distinct l_orderkey, l_linenumber from lineitem),
m as (select l_orderkey, max(l_linenumber) as top from c group by 1),
w as (select l_orderkey, cast(unnest(generate_series(1, top)) as integer) as missing from m)
select w.* from w left join c on c.l_orderkey = w.l_orderkey and l_linenumber = missing where l_linenumber is null
"""


def cascade_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment for each nation: its richest customer's, else any supplier's mark, else the region's name; with the route taken."""
    customers = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max_by("c_mktsegment", F.struct("c_acctbal", "c_custkey")).alias("a"))
    suppliers = _table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_name").alias("b"))
    x = _table(spark, sf_dir, "nation").join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    x = x.join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    route = F.when(F.col("a").isNotNull(), "customer").when(F.col("b").isNotNull(), "supplier").otherwise("region")
    return x.select("n_nationkey", F.coalesce("a", "b", "r_name").alias("value"), route.alias("route"))


CASCADE_SQL = """
with c as (select c_nationkey, arg_max(c_mktsegment, row(c_acctbal, c_custkey)) as a from customer group by 1),
s as (select s_nationkey, min(s_name) as b from supplier group by 1)
select n_nationkey, coalesce(a, b, r_name) as value,
  case when a is not null then 'customer' when b is not null then 'supplier' else 'region' end as route
from nation left join c on n_nationkey = c_nationkey left join s on n_nationkey = s_nationkey left join region on n_regionkey = r_regionkey
"""


def set_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that hold the same set of parts: the least order of each and how many there are."""
    sets = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    return sets.groupBy("parts").agg(F.min("l_orderkey").alias("first_order"), F.count(F.lit(1)).alias("orders")).where("orders > 1").select("first_order", "orders", F.size("parts").cast("long").alias("n_parts"))


SET_KEY_SQL = """
with s as (select l_orderkey, list_sort(list_distinct(list(l_partkey))) as parts from lineitem group by 1)
select min(l_orderkey) as first_order, count(*) as orders, cast(len(any_value(parts)) as bigint) as n_parts from s group by parts having count(*) > 1
"""


def dangling_and_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order, parts never sold, and suppliers never used, counted by kind."""
    orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    kinds = (("customer", "c_custkey", orders, "o_custkey"), ("part", "p_partkey", lines, "l_partkey"), ("supplier", "s_suppkey", lines, "l_suppkey"))
    out = None
    for name, key, used, by in kinds:
        one = _table(spark, sf_dir, name).select(F.col(key).alias("id")).join(used.select(F.col(by).alias("id")), "id", "left_anti").agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
        out = one if out is None else out.unionByName(one)
    return out


DANGLING_SQL = """
select 'customer' as kind, count(*) as n, min(c_custkey) as first_id from customer where c_custkey not in (select o_custkey from orders)
union all select 'part', count(*), min(p_partkey) from part where p_partkey not in (select l_partkey from lineitem)
union all select 'supplier', count(*), min(s_suppkey) from supplier where s_suppkey not in (select l_suppkey from lineitem)
"""

QUERIES = {"range_rule_resolve": range_rule_resolve, "span_resolve_open_bounds": span_resolve_open_bounds, "sequence_gaps": sequence_gaps, "cascade_lookup": cascade_lookup, "set_key_join": set_key_join, "dangling_and_todo": dangling_and_todo}
SQL = {"range_rule_resolve": RANGE_RULE_SQL, "span_resolve_open_bounds": SPAN_SQL, "sequence_gaps": GAPS_SQL, "cascade_lookup": CASCADE_SQL, "set_key_join": SET_KEY_SQL, "dangling_and_todo": DANGLING_SQL}
