"""Folded text: aliases, trigram votes, line operators, search, scans of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.text import ACCENTED, PLAIN, fold, key_fold
from loomwright.operators import matching
from loomwright.plans.corpora import _table

_FOLD_SQL = f"trim(regexp_replace(translate(lower({{}}), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]+', ' ', 'g'))"
ALIASES = "values ('brass', 'metal'), ('steel', 'metal'), ('polished brass', 'finish'), ('large', 'size'), ('small', 'size'), ('promo', 'sale'), ('brand', 'sale') as aliases(alias, target)"


def longest_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select("p_partkey", key_fold(F.concat_ws(" ", "p_name", "p_type")).alias("key"))
    return matching.longest_alias(rows, "key", spark.sql(f"select * from {ALIASES}")).select("p_partkey", "alias", "target")


ALIAS_SQL = f"""
with a as (select * from ({ALIASES.replace(' as aliases', ') as aliases')}),
p as (select p_partkey, ' ' || {_FOLD_SQL.format("concat_ws(' ', p_name, p_type)")} || ' ' as key from part),
h as (select p_partkey, alias, target, row_number() over (partition by p_partkey order by length(alias) desc,
    length(key) - instr(reverse(key), reverse(' ' || alias || ' ')) desc, alias, target) as k
  from p join a on contains(key, ' ' || alias || ' '))
select p.p_partkey, alias, target from p left join h on h.p_partkey = p.p_partkey and k = 1
"""


def trigram_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark item of which a document holds most word trigrams, from 45 percent on."""
    return matching.trigram_votes(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "benchmark"), "item_id", "text", 0.45)


_GRAMS = "list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"
TRIGRAM_SQL = f"""
with d as (select doc_id, list_filter(string_split({_FOLD_SQL.format('text')}, ' '), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(string_split({_FOLD_SQL.format('text')}, ' '), lambda x: x <> '') as w from benchmark),
g as (select doc_id, unnest({_GRAMS}) as g from d), i as (select item_id, unnest({_GRAMS}) as g from b),
s as (select item_id, count(*) as size from i group by 1),
v as (select doc_id, i.item_id, count(*) as votes, any_value(size) as size from g join i on i.g = g.g join s on s.item_id = i.item_id group by all)
select doc_id, arg_min(item_id, row(-votes, item_id)) as item_id, max(votes) as votes, arg_min(size, row(-votes, item_id)) as size
from v where votes >= 0.45 * size group by 1
"""


def unwrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in four and more documents go; the rest of a document is joined to one line, hyphens at line ends repaired. Returns sizes."""
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    common = lines.where("line <> ''").select("doc_id", "line").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").select("line")
    kept = lines.join(common, "line", "left_anti")
    body = kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("t"), F.count(F.lit(1)).alias("lines"))
    joined = F.regexp_replace(F.replace("t", F.lit("-\n"), F.lit("")), "\n+", " ")
    return body.select("doc_id", "lines", F.length(joined).cast("long").alias("chars"))


UNWRAP_SQL = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
c as (select line from l where line <> '' group by 1 having count(distinct doc_id) >= 4),
b as (select doc_id, string_agg(line, chr(10) order by pos) as t, count(*) as lines from l where line not in (select line from c) group by 1)
select doc_id, lines, length(regexp_replace(replace(t, '-' || chr(10), ''), '\n+', ' ', 'g')) as chars from b
"""


def html_paragraph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed paragraphs of each page after scripts are cut out: number, distinct link targets, characters without tags."""
    pages = _table(spark, sf_dir, "pages")
    clean = F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
    x = pages.select("page_id", F.regexp_extract_all(clean, F.lit("(?s)<p[^>]*>(.*?)</p>"), 1).alias("p"), F.regexp_extract_all(clean, F.lit('href="([^"]*)"'), 1).alias("links"))
    chars = F.aggregate("p", F.lit(0), lambda s, t: s + F.length(F.regexp_replace(t, "<[^>]*>", "")))
    return x.select("page_id", F.size("p").cast("long").alias("paragraphs"), F.size(F.array_distinct("links")).cast("long").alias("links"), chars.cast("long").alias("chars"))


PARAGRAPH_SQL = """
with c as (select page_id, regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs') as h from pages),
x as (select page_id, regexp_extract_all(h, '<p[^>]*>(.*?)</p>', 1, 's') as p, list_distinct(regexp_extract_all(h, 'href="([^"]*)"', 1)) as links from c)
select page_id, cast(len(p) as bigint) as paragraphs, cast(len(links) as bigint) as links,
  cast(coalesce(list_sum(list_transform(p, lambda t: length(regexp_replace(t, '<[^>]*>', '', 'g')))), 0) as bigint) as chars from x
"""


def search_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 documents for a search: hits in the text before hits of all words in the source, by id."""
    needle, parts = "the of", ["src", "1"]
    x = _table(spark, sf_dir, "documents").select("doc_id", fold(F.coalesce("text", F.lit(""))).alias("t"), fold(F.coalesce("source", F.lit(""))).alias("s"))
    every = F.lit(True)
    for word in parts:
        every = every & F.contains("s", F.lit(word))
    tier = F.when(F.instr("t", needle) > 0, 1).when(every, 2)
    hits = x.select("doc_id", tier.alias("tier"), F.instr("t", needle).alias("at")).where("tier is not null")
    return hits.orderBy("tier", "doc_id").limit(300)


SEARCH_SQL = f"""
with x as (select doc_id, translate(lower(coalesce(text, '')), '{ACCENTED}', '{PLAIN}') as t, translate(lower(coalesce(source, '')), '{ACCENTED}', '{PLAIN}') as s from documents),
h as (select doc_id, case when instr(t, 'the of') > 0 then 1 when contains(s, 'src') and contains(s, '1') then 2 end as tier, cast(instr(t, 'the of') as integer) as "at" from x)
select * from h where tier is not null order by tier, doc_id limit 300
"""


def suffix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endings of three to eight letters that nearly always go with one language."""
    words = _table(spark, sf_dir, "documents").where("text is not null and lang is not null").select("lang", F.explode(F.split(key_fold("text"), " ")).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    ends = words.select("lang", "n", "w", F.explode(F.sequence(F.lit(3), F.lit(8))).alias("k")).where("length(w) > k").select("lang", "n", F.expr("right(w, k)").alias("ending"))
    counted = ends.groupBy("ending", "lang").agg(F.sum("n").alias("n"))
    total = counted.groupBy("ending").agg(F.sum("n").alias("cases"), F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.max("n").alias("agree"))
    return total.where("cases >= 25 and agree >= 0.995 * cases")


SUFFIX_SQL = f"""
with w as (select lang, unnest(string_split({_FOLD_SQL.format('text')}, ' ')) as w from documents where text is not null and lang is not null),
e as (select lang, right(w, k) as ending from w, range(3, 9) t(k) where length(w) > k),
c as (select ending, lang, count(*) as n from e group by all)
select ending, cast(sum(n) as bigint) as cases, arg_max(lang, row(n, lang)) as lang, max(n) as agree from c group by 1 having sum(n) >= 25 and max(n) >= 0.995 * sum(n)
"""

QUERIES = {"longest_alias": longest_alias, "trigram_equivalence": trigram_equivalence, "unwrap_lines": unwrap_lines, "html_paragraph_scan": html_paragraph_scan, "search_tiers": search_tiers, "suffix_rules": suffix_rules}
SQL = {"longest_alias": ALIAS_SQL, "trigram_equivalence": TRIGRAM_SQL, "unwrap_lines": UNWRAP_SQL, "html_paragraph_scan": PARAGRAPH_SQL, "search_tiers": SEARCH_SQL, "suffix_rules": SUFFIX_SQL}
