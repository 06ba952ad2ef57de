"""Queries of the audit operators: crosschecks, coverage, facts side by side, indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text
from loomwright.operators import audit
from loomwright.plans.corpora import _table


def count_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that an order should have by its key against those it has; orders of status F are explained."""
    orders = _table(spark, sf_dir, "orders")
    asked = orders.select("o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("asked"))
    got = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_linenumber").alias("got"))
    return audit.count_crosscheck(asked, got, ["o_orderkey"], orders.where("o_orderstatus = 'F'"))


CROSSCHECK_SQL = """
with a as (select o_orderkey, o_orderkey % 7 + 1 as asked, o_orderstatus = 'F' as why from orders), g as (select l_orderkey, count(distinct l_linenumber) as got from lineitem group by 1),
x as (select coalesce(o_orderkey, l_orderkey) as o_orderkey, coalesce(asked, 0) as asked, coalesce(got, 0) as got, why from a full join g on o_orderkey = l_orderkey)
select o_orderkey, asked, got, case when asked = got then 'equal' when why then 'explained' else 'differs' end as status from x
"""


def inventory_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of customers against customers that have an order of the first half of any year."""
    index = _table(spark, sf_dir, "customer").select((F.col("c_custkey") + 40).alias("k"))
    return audit.reconcile(index, _table(spark, sf_dir, "orders").where("month(o_orderdate) <= 6").select(F.col("o_custkey").alias("k")), ["k"])


RECONCILE_SQL = """
with a as (select distinct c_custkey + 40 as k from customer), b as (select distinct o_custkey as k from orders where month(o_orderdate) <= 6)
select coalesce(a.k, b.k) as k, case when a.k is null then 'content' when b.k is null then 'index' else 'both' end as place from a full join b on a.k = b.k
"""


def audit_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each year's orders as reckoned from orders, against the same from lines; what differs."""
    orders = _table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    lines = _table(spark, sf_dir, "lineitem").join(orders.select("o_orderkey", "year", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = lambda df, key: df.groupBy("year").agg(F.count_distinct(key).alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.min(key).alias("first"), F.max(key).alias("last"))
    return audit.fact_audit(named(orders, "o_orderkey"), named(lines, "l_orderkey"), ["year"], ["orders", "customers", "first", "last"])


UNPIVOT_SQL = """
with o as (select *, cast(year(o_orderdate) as int) as year from orders), l as (select o.* from lineitem join o on l_orderkey = o_orderkey),
a as (select year, count(distinct o_orderkey) as orders, count(distinct o_custkey) as customers, min(o_orderkey) as first, max(o_orderkey) as last from o group by 1),
b as (select year, count(distinct o_orderkey) as orders, count(distinct o_custkey) as customers, min(o_orderkey) as first, max(o_orderkey) as last from l group by 1),
u as (unpivot (select year, orders::varchar as orders, customers::varchar as customers, first::varchar as first, last::varchar as last from a) on orders, customers, first, last into name fact value computed),
v as (unpivot (select year, orders::varchar as orders, customers::varchar as customers, first::varchar as first, last::varchar as last from b) on orders, customers, first, last into name fact value printed)
select coalesce(u.year, v.year) as year, coalesce(u.fact, v.fact) as fact, computed, printed from u full join v on u.year = v.year and u.fact = v.fact where computed is distinct from printed
"""


def coverage_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user has a purchase on its day of the month, on others only, or never."""
    x = _table(spark, sf_dir, "events")
    items = x.select("user_id").distinct().withColumn("dom", (F.col("user_id") % 28 + 1).cast("int"))
    return audit.coverage(items, x.where("event_type = 'purchase' and value > 20").select("user_id", F.dayofmonth("ts").alias("dom")), "user_id", "dom")


COVERAGE_SQL = """
with i as (select distinct user_id, cast(user_id % 28 + 1 as int) as dom from events), s as (select distinct user_id, cast(day(ts) as int) as dom from events where event_type = 'purchase' and value > 20)
select user_id, dom, case when exists (select 1 from s where s.user_id = i.user_id and s.dom = i.dom) then 'own_day' when exists (select 1 from s where s.user_id = i.user_id) then 'other_day' else 'never' end as coverage from i
"""


def outcome_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by year and return flag, with each flag's share of its year, a table of the flags across, and totals."""
    x = _table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), "l_returnflag")
    table = x.groupBy("year").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1))).na.fill(0)
    shares = audit.share_of_total(x, ["year", "l_returnflag"], ["year"]).where("l_returnflag = 'R'").select("year", F.round("share", 6).alias("share_r"))
    return table.join(shares, "year", "left")


CROSSTAB_SQL = """
select cast(year(l_shipdate) as int) as year, count(*) filter (where l_returnflag = 'A') as A, count(*) filter (where l_returnflag = 'N') as N, count(*) filter (where l_returnflag = 'R') as R,
  case when count(*) filter (where l_returnflag = 'R') > 0 then round(count(*) filter (where l_returnflag = 'R') / count(*), 6) end as share_r
from lineitem where l_returnflag in ('A', 'N', 'R') group by 1
"""


def two_level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many days and users have so many events."""
    return audit.histogram_of_counts(_table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")), ["user_id", "day"])


HISTOGRAM_SQL = "select size, count(*) as keys from (select count(*) as size from events group by user_id, cast(ts as date)) group by 1"


def nested_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by region, nation and segment, with the sums of each level (level 0 to 3)."""
    x = _table(spark, sf_dir, "customer").join(F.broadcast(_table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    level = (F.lit(3) - F.grouping("n_regionkey").cast("int") - F.grouping("n_nationkey").cast("int") - F.grouping("c_mktsegment").cast("int")).alias("level")
    return x.rollup("n_regionkey", "n_nationkey", "c_mktsegment").agg(level, F.count(F.lit(1)).alias("n"), F.count_distinct("n_nationkey").alias("nations"))


ROLLUP_SQL = """
select n_regionkey, n_nationkey, c_mktsegment, cast(3 - grouping(n_regionkey) - grouping(n_nationkey) - grouping(c_mktsegment) as int) as level, count(*) as n, count(distinct n_nationkey) as nations
from customer join nation on c_nationkey = n_nationkey group by rollup (n_regionkey, n_nationkey, c_mktsegment)
"""


def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part and supplier the orders and lines where they stand, in order."""
    done = audit.inverted_index(_table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])
    return done.select("l_partkey", "l_suppkey", F.array_join(F.transform("places", lambda p: F.concat_ws("-", p["l_orderkey"].cast("string"), p["l_linenumber"].cast("string"))), " ").alias("places"), "n")


INDEX_SQL = """
with d as (select distinct l_partkey, l_suppkey, l_orderkey, l_linenumber from lineitem)
select l_partkey, l_suppkey, string_agg(l_orderkey || '-' || l_linenumber, ' ' order by l_orderkey, l_linenumber) as places, count(*) as n from d group by 1, 2
"""


def source_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best share of common words between the first lines of French and English documents of a source and twenty neighbouring keys, binned."""
    x = _table(spark, sf_dir, "documents").where("text is not null")
    x = x.select("source", "lang", "doc_id", text.words(F.substring_index("text", "\n", 1)).alias("tokens")).where("size(tokens) > 0")
    ours = x.where("lang = 'fr'").withColumn("k", F.expr("doc_id div 20"))
    theirs = x.where("lang = 'en'").withColumn("k", F.expr("doc_id div 20"))
    done = audit.best_agreement(ours.select("source", "k", "tokens"), theirs.select("source", "k", "tokens"), ["source", "k"], "tokens", [(0.2, "close"), (0.05, "loose")], "apart")
    return done.select("source", "k", F.round("similarity", 6).alias("similarity"), "bin")


def verified_by_two_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer of each line by its order, against the nation by its supplier: agrees, differs, or one path is missing."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    one = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("a"))
    two = _table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("b"))
    x = lines.join(one, "l_orderkey", "left").join(two, "l_suppkey", "left")
    status = F.when(F.col("a").isNull() & F.col("b").isNull(), "neither").when(F.col("a").isNull() | F.col("b").isNull(), "one path").when(F.col("a") == F.col("b"), "agrees").otherwise("differs")
    return x.groupBy("l_linenumber", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


TWO_PATHS_SQL = """
with x as (select l_linenumber, c_nationkey as a, s_nationkey as b from lineitem left join (orders join customer on o_custkey = c_custkey) on o_orderkey = l_orderkey left join (select * from supplier where s_acctbal > 0) s on s_suppkey = l_suppkey)
select l_linenumber, case when a is null and b is null then 'neither' when a is null or b is null then 'one path' when a = b then 'agrees' else 'differs' end as status, count(*) as n from x group by 1, 2
"""


def letter_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose letters a typographic cleanup changed, and what keys lose when dashes are folded."""
    x = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    letters = lambda c: F.regexp_replace(c, "[^A-Za-z]+", "")
    cleaned = text.typographic(F.col("text"))
    x = x.select("doc_id", (letters(F.col("text")) == letters(cleaned)).alias("whole"), F.length(cleaned).cast("long").alias("n"), F.md5(F.regexp_replace("text", "-", "").cast("binary")).alias("folded"))
    twins = x.groupBy("folded").agg(F.count(F.lit(1)).alias("alike"))
    return x.join(twins, "folded").select("doc_id", "whole", "n", "alike")


INTEGRITY_SQL = r"""
with x as (select doc_id, coalesce(text, '') as text from documents),
y as (select *, regexp_replace(regexp_replace(replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), '’', ''''), '…', '...'), '[ \t]+([,.;:!?])', '\1', 'g'), '[ \t]+', ' ', 'g') as c from x)
select doc_id, regexp_replace(text, '[^A-Za-z]+', '', 'g') = regexp_replace(c, '[^A-Za-z]+', '', 'g') as whole, cast(len(c) as bigint) as n, count(*) over (partition by replace(text, '-', '')) as alike from y
"""

AGREEMENT_SQL = r"""
with d as (select source, lang, doc_id // 20 as k, string_split(text, chr(10))[1] as l from documents where text is not null),
t as (select source, lang, k, list_distinct(list_filter(string_split(trim(regexp_replace(translate(lower(l), 'áàâäãåéèêëíìîïóòôöõúùûüñç', 'aaaaaaeeeeiiiiooooouuuunc'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')) as w from d),
f as (select * from t where len(w) > 0),
x as (select a.source, a.k, max(case when b.w is not null then len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)) end) as s from f a left join f b on b.lang = 'en' and b.source = a.source and b.k = a.k where a.lang = 'fr' group by 1, 2)
select source, k, round(s, 6) as similarity, case when s is null then 'no witness' when s >= 0.2 then 'close' when s >= 0.05 then 'loose' else 'apart' end as bin from x
"""

QUERIES = {"count_crosscheck": count_crosscheck, "inventory_reconciliation": inventory_reconciliation, "audit_unpivot": audit_unpivot, "coverage_tristate": coverage_tristate, "outcome_crosstab": outcome_crosstab, "two_level_histogram": two_level_histogram, "nested_rollup": nested_rollup, "inverted_index": inverted_index, "source_agreement": source_agreement, "verified_by_two_paths": verified_by_two_paths, "letter_integrity": letter_integrity}
SQL = {"count_crosscheck": CROSSCHECK_SQL, "inventory_reconciliation": RECONCILE_SQL, "audit_unpivot": UNPIVOT_SQL, "coverage_tristate": COVERAGE_SQL, "outcome_crosstab": CROSSTAB_SQL, "two_level_histogram": HISTOGRAM_SQL, "nested_rollup": ROLLUP_SQL, "inverted_index": INDEX_SQL, "source_agreement": AGREEMENT_SQL, "verified_by_two_paths": TWO_PATHS_SQL, "letter_integrity": INTEGRITY_SQL}
