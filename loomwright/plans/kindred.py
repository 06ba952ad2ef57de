"""Queries of the similarity operators and of the folds of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text
from loomwright.operators import similarity
from loomwright.plans.corpora import _table

_FOLD = "translate(lower({0}), 'áàâäãåéèêëíìîïóòôöõúùûüñç', 'aaaaaaeeeeiiiiooooouuuunc')"
_WORDS = "list_filter(string_split(trim(regexp_replace(" + _FOLD + ", '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"


def edit_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different part names within two edits of each other, the smaller name first."""
    names = _table(spark, sf_dir, "part").select("p_name").distinct()
    pairs = similarity.edit_join(names.select(F.col("p_name").alias("a"), "p_name"), names.select(F.col("p_name").alias("b"), "p_name"), "a", "b", "p_name")
    return pairs.where("a < b").select("a", "b", F.col("distance").cast("long").alias("distance"))


EDIT_SQL = "with n as (select distinct p_name as t from part) select x.t as a, y.t as b, levenshtein(x.t, y.t) as distance from n x join n y on x.t < y.t and abs(len(x.t) - len(y.t)) <= 2 where levenshtein(x.t, y.t) <= 2"


def typo_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of paths of links in pages, each by the most frequent one within two edits."""
    paths = _table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="/([a-z]{4,9})"'), 1)).alias("name"))
    names = paths.groupBy("name").agg(F.count(F.lit(1)).alias("many"))
    return similarity.merge_typos(names, "name", "many", 1)


TYPO_SQL = """
with p as (select unnest(regexp_extract_all(html, 'href="/([a-z]{4,9})"', 1)) as name from pages), n as (select name, count(*) as many from p group by 1),
x as (select a.name, arg_min(b.name, row(-b.many, levenshtein(a.name, b.name), b.name)) as best from n a join n b on b.many > a.many and levenshtein(a.name, b.name) <= 1 group by 1)
select n.name, coalesce(best, n.name) as merged from n left join x on x.name = n.name
"""


def token_set_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that are the same words in another order, by the most frequent of them."""
    names = _table(spark, sf_dir, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("many")).withColumn("tokens", text.words(F.col("p_name")))
    return similarity.merge_token_sets(names, "p_name", "many", "tokens")


TOKEN_SET_SQL = """
with n as (select p_name, count(*) as many, list_sort(list_distinct(string_split(p_name, ' '))) as s from part group by 1)
select p_name, first_value(p_name) over (partition by s order by many desc, p_name) as merged from n
"""


def net_new_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines, folded, of French documents that no English one begins with."""
    x = _table(spark, sf_dir, "documents").select("doc_id", "lang", text.text_key(F.substring_index("text", "\n", 1)).alias("line"))
    return similarity.net_new(x.where("lang = 'en'"), x.where("lang = 'fr'"), "line").select("doc_id", "line")


NET_NEW_SQL = f"""
with x as (select doc_id, lang, trim(regexp_replace({_FOLD.format("string_split(text, chr(10))[1]")}, '[^a-z0-9]+', ' ', 'g')) as line from documents)
select doc_id, line from x a where lang = 'fr' and len(line) >= 25 and not exists (select 1 from x b where b.lang = 'en' and b.line = a.line)
"""


def incipit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the smallest other-language document that begins with the same four words."""
    x = _table(spark, sf_dir, "documents").select("doc_id", "lang", text.words(F.substring_index("text", "\n", 1)).alias("tokens"))
    left, right = x.where("lang <> 'en'"), x.where("lang = 'en'").withColumnRenamed("doc_id", "other")
    first = similarity.incipit_join(left, right, "doc_id", "other", "tokens")
    same = similarity.incipit_join(x, x.withColumnRenamed("doc_id", "earliest"), "doc_id", "earliest", "tokens")
    return same.join(first, "doc_id", "left")


INCIPIT_SQL = f"""
with x as (select doc_id, lang, {_WORDS.format("string_split(text, chr(10))[1]")} as w from documents),
y as (select doc_id, lang, case when len(w) >= 4 then array_to_string(w[1:4], ' ') end as b from x)
select doc_id, case when b is not null then min(doc_id) over (partition by b) end as earliest,
  case when lang <> 'en' and b is not null then min(case when lang = 'en' then doc_id end) over (partition by b) end as other from y
"""


def fold_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All folds of each document's first line side by side."""
    line = F.coalesce(F.substring_index("text", "\n", 1), F.lit(""))
    x = _table(spark, sf_dir, "documents").select("doc_id", line.alias("line"))
    c = F.col("line")
    return x.select("doc_id", text.search_fold(c).alias("search"), text.text_key(c).alias("key"), text.letter_key(c).alias("letters"), text.squeezed(c).alias("squeezed"), text.squeezed_dots(c).alias("dotted"), text.slug(F.left(c, F.lit(30)), F.col("doc_id") % 1000).alias("slug"), F.array_join(text.root_keys(c), " ").alias("roots"))


_ROOT = "v"
for _a, _b in text.DIGRAPHS:
    _ROOT = f"replace({_ROOT}, '{_a}', '{_b}')"
FOLDS_SQL = rf"""
with x as (select doc_id, coalesce(string_split(text, chr(10))[1], '') as line from documents),
y as (select *, {_WORDS.format("line")} as w, lower(regexp_replace(translate(line, '–—−', '---'), '\s+', '', 'g')) as q from x),
r as (select *, list_transform(list_filter({_WORDS.format("replace(replace(replace(line, 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss')")}, lambda v: v not in ('the', 'of', 'and', 'de', 'la', 'et', 'en', 'und', 'der')), lambda v: case when regexp_full_match(v, '[0-9]+') then '#' || v
  else left({_ROOT}, 4) end) as k from y)
select doc_id, replace(replace(replace({_FOLD.format("line")}, 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss') as search, array_to_string(w, ' ') as key, regexp_replace({_FOLD.format("line")}, '[^a-z]+', '', 'g') as letters,
  q as squeezed, translate(q, ',', '.') as dotted, concat_ws('-', replace(trim(regexp_replace({_FOLD.format("left(line, 30)")}, '[^a-z0-9]+', ' ', 'g')), ' ', '-'), lpad(cast(doc_id % 1000 as varchar), 3, '0')) as slug,
  array_to_string(list_filter(k, lambda v, i: list_position(k, v) = i), ' ') as roots
from r
"""


def lax_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring words in part names: whether they begin alike, and the overlap of their letters with the next part's."""
    x = _table(spark, sf_dir, "part").select("p_partkey", text.words(F.col("p_name")).alias("w"), text.words(F.col("p_type")).alias("t"))
    letters = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda s: s != ""))
    a, b = letters(F.array_join("w", "")), letters(F.array_join("t", ""))
    return x.select("p_partkey", text.lax_equal(F.col("w")[0], F.try_element_at("w", F.lit(2))).alias("alike"), F.round(text.overlap(a, b), 6).alias("of_smaller"), F.round(text.overlap(a, b, "greatest"), 6).alias("of_larger"))


LAX_SQL = """
with x as (select p_partkey, string_split(p_name, ' ')[1] as a, string_split(p_name, ' ')[2] as b, list_distinct(string_split(replace(lower(p_name), ' ', ''), '')) as u, list_distinct(string_split(replace(lower(p_type), ' ', ''), '')) as v from part),
y as (select *, case when len(a) <= 3 or len(b) <= 3 then 3 else 4 end as n, len(list_intersect(u, v)) as c from x)
select p_partkey, len(a) >= 3 and len(b) >= 3 and left(a, n) = left(b, n) as alike, round(c / least(len(u), len(v)), 6) as of_smaller, round(c / greatest(len(u), len(v)), 6) as of_larger from y
"""


def roman_and_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's key as a Roman numeral and back, and the length and digest of its text without tags and references."""
    x = _table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 3999 + 1).alias("n"), text.clean_markup(F.coalesce("html", F.lit(""))).alias("plain"))
    x = x.withColumn("roman", text.to_roman(F.col("n")))
    return x.select("page_id", "roman", text.from_roman(F.col("roman")).cast("long").alias("back"), F.length("plain").cast("long").alias("n_chars"), F.md5(F.col("plain").cast("binary")).alias("print"))


ROMAN_SQL = r"""
with x as (select page_id, page_id % 3999 + 1 as n, regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') as h from pages),
y as (select *, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g'), ' ') as plain from x)
select page_id, repeat('M', n // 1000) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][n // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1]
  || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] as roman, n as back, cast(len(plain) as bigint) as n_chars, md5(plain) as print from y
"""

QUERIES = {"edit_similarity_join": edit_similarity_join, "typo_merge": typo_merge, "token_set_merge": token_set_merge, "net_new_lines": net_new_lines, "incipit_lookup": incipit_lookup, "fold_variants": fold_variants, "lax_names": lax_names, "roman_and_markup": roman_and_markup}
SQL = {"edit_similarity_join": EDIT_SQL, "typo_merge": TYPO_SQL, "token_set_merge": TOKEN_SET_SQL, "net_new_lines": NET_NEW_SQL, "incipit_lookup": INCIPIT_SQL, "fold_variants": FOLDS_SQL, "lax_names": LAX_SQL, "roman_and_markup": ROMAN_SQL}
