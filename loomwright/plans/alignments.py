"""Lists matched in order, and words cut out of text without spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text
from loomwright.operators import alignment, segmentation
from loomwright.plans.corpora import _table
from loomwright.plans.kindred import _WORDS
from loomwright.sources.shared import new_path


def staged(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's and the assistant's turns of each conversation, matched in order by the words that they share."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_distinct(text.words(F.col("text"))).alias("words"))
    return alignment.ordered_alignment(turns.where("role = 'user'"), turns.where("role = 'assistant'"), ["conv_id"], "turn", "words")


ALIGNMENT_SQL = f"""
with recursive t as (select conv_id, turn, role, list_distinct(coalesce({_WORDS.format("text")}, [])) as words,
    row_number() over (partition by conv_id, role order by turn, list_sort(list_distinct(coalesce({_WORDS.format("text")}, [])))) as k from conversations),
l as (select conv_id, turn, words, k as i from t where role = 'user'), r as (select conv_id, turn, words, k as j from t where role = 'assistant'),
s as (select l.conv_id, l.turn, i, list(len(list_intersect(l.words, r.words)) / greatest(least(len(l.words), len(r.words)), 1)::double order by j) filter (r.j is not null) as s,
    list(r.turn order by j) filter (r.j is not null) as partners from l left join r using (conv_id) group by all),
sized as (select *, coalesce(len(s), 0) as m from s),
dp as (
  select distinct conv_id, 0::bigint as i, list_transform(range(m + 1), lambda x: 0::double) as best, cast([] as int[]) as how from sized
  union all
  select conv_id, i, list_transform(range(1, m + 2), lambda x: list_max(chosen[1:x])) as best,
    list_transform(range(1, m + 2), lambda x: case when x > 1 and list_max(chosen[1:x - 1]) > chosen[x] then 2 when paired[x] > skipped[x] then 1 else 0 end) as how
  from (select *, list_transform(range(1, m + 2), lambda x: greatest(skipped[x], paired[x])) as chosen from (
    select d.conv_id, z.i, m, list_transform(d.best, lambda b: b - 0.01::double) as skipped,
      list_prepend('-infinity'::double, list_transform(range(1, m + 1), lambda x: d.best[x] + case when z.s[x] = 0 then 0.02::double else z.s[x] end)) as paired
    from dp d join sized z on z.conv_id = d.conv_id and z.i = d.i + 1))
),
back as (
  select conv_id, max(i) as i, len(any_value(best)) as j, cast(null as bigint) as left_i, cast(null as bigint) as right_j from dp group by conv_id
  union all
  select b.conv_id, case when d.how[b.j] = 2 then b.i else b.i - 1 end, case when d.how[b.j] = 0 then b.j else b.j - 1 end,
    case when d.how[b.j] <> 2 then b.i end, case when d.how[b.j] = 1 then b.j - 1 end
  from back b join dp d on d.conv_id = b.conv_id and d.i = b.i where b.i > 0
)
select b.conv_id, z.turn, z.partners[right_j] as partner, z.s[right_j] as score from back b join sized z on z.conv_id = b.conv_id and z.i = b.left_i where left_i is not null
"""


def segment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its blanks, cut into words by costs that two thirds of the documents teach; cuts found, true and right.

    Documents whose crc32 of the id modulo 3 is 1 are held out.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    lines = docs.where(~held).select(F.explode(F.split("text", "\n")).alias("line"))
    vocabulary = staged(segmentation.word_costs(lines, "line"), "word-costs")
    true = F.regexp_extract_all("text", F.lit(r"([\p{L}]+|[\p{Nd}]+|[^\p{L}\p{Nd} ])"), 1)
    closed = docs.select("doc_id", held.alias("held_out"), "text", F.translate("text", " ", "").alias("closed"))
    cut = segmentation.segment(closed, "closed", vocabulary, true=true, keep=["doc_id", "held_out"])
    return cut.select("doc_id", "held_out", "n_found", "n_true", "n_right", F.md5(segmentation.put_together(F.col("parts")).cast("binary")).alias("print"))


QUERIES = {"ordered_alignment": ordered_alignment, "segment_words": segment_words}
SQL = {"ordered_alignment": ALIGNMENT_SQL}
