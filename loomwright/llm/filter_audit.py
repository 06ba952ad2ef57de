"""Filter interaction audit: what each filter removes under every order of the filters.

Every document becomes a mask of the filters that it fails; one aggregate
leaves at most 2^k cells a part. All k! orders are visited by single swaps of
neighbours (plain changes), so that a visit works out only the two steps that
its swap touches, as sums of mask cells; the Shapley sums grow along the walk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.llm.common import drop_tables, table

#: Parts whose rows are put together at once (each has k * k! rows).
PARTS_AT_ONCE = 64
STATS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain_changes(k: int) -> Iterator[int]:
    """The places i of the swaps (i, i + 1) that lead through all orders of k things, each once."""
    if k < 2:
        return
    inner = plain_changes(k - 1)
    down = True
    while True:
        yield from range(k - 2, -1, -1) if down else range(k - 1)
        swap = next(inner, None)
        if swap is None:
            return
        # the largest thing rests at one end; the others stand behind it if it rests at the front
        yield swap + 1 if down else swap
        down = not down


def _one_step(cells: np.ndarray, before: int, own: int) -> np.ndarray:
    """kept, removed, redundant, unique_fails, good_lost, toxic_lost of one filter after the filters in `before`, for each part."""
    mask = np.arange(cells.shape[1])
    there, fails = (mask & before) == 0, (mask & own) != 0
    gone = cells[:, there & fails].sum(1)
    kept = cells[:, there & ~fails, 0].sum(1)
    redundant = cells[:, ~there & fails, 0].sum(1)
    return np.stack([kept, gone[:, 0], redundant, cells[:, own, 0], gone[:, 1], gone[:, 2]], 1)


def walk(cells: np.ndarray, letters: str) -> tuple[list[str], np.ndarray]:
    """All orders of the letters, and (orders, parts, steps, STATS) of cells(part, mask, (rows, good, toxic))."""
    k = len(letters)
    order = list(range(k))
    state = np.zeros((len(cells), k, len(STATS) - 1), np.int64)
    shapley = np.zeros((len(cells), k), np.int64)

    def refresh(first: int, last: int) -> None:
        before = sum(1 << f for f in order[:first])
        for i in range(first, last):
            state[:, i] = _one_step(cells, before, 1 << order[i])
            before |= 1 << order[i]

    names, seen, placed = [], [], []

    def visit() -> None:
        names.append("".join(letters[f] for f in order))
        seen.append(state.copy())
        placed.append(list(order))
        shapley[:, order] += state[:, :, 1]

    refresh(0, k)
    visit()
    for i in plain_changes(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        refresh(i, i + 2)
        visit()
    whole = np.stack([shapley[:, o] for o in placed])[..., None]
    return names, np.concatenate([np.stack(seen), whole], 3)


def failure_counts(masked: DataFrame, part: str, mask: str, n: str, good: str, toxic: str) -> DataFrame:
    """part, and its cells (mask, n, good, toxic), summed: at most one for each mask. Counted in the tasks before rows move."""
    counted = masked.groupBy(part, mask).agg(F.sum(n).alias("n"), F.sum(good).alias("good"), F.sum(toxic).alias("toxic"))
    return counted.groupBy(part).agg(F.collect_list(F.struct(F.col(mask).alias("mask"), "n", "good", "toxic")).alias("cells"))


def audit(counts: DataFrame, part: str, letters: str) -> DataFrame:
    """part, filter_order, step and STATS for every part of failure_counts, order and step; zeros included.

    Bit i of a mask is letter i. The work of a part depends on the number of
    filters alone. No parts: no rows.
    """
    columns = f"{part} string, filter_order string, step int, " + ", ".join(f"{c} long" for c in STATS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        k = len(letters)
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                some = batch.slice(at, PARTS_AT_ONCE)
                flat = some.column(1)
                owner = np.repeat(np.arange(some.num_rows), flat.value_lengths().to_numpy(zero_copy_only=False))
                fields = flat.flatten()
                mask, *values = (fields.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
                cells = np.zeros((some.num_rows, 1 << k, 3), np.int64)
                for i, v in enumerate(values):
                    cells[owner, mask, i] = v
                names, stats = walk(cells, letters)
                n, p = len(names), some.num_rows
                parts = some.column(0).take(pa.array(np.repeat(np.arange(p), n * k)))
                orders = pa.array(names).take(pa.array(np.tile(np.repeat(np.arange(n), k), p)))
                steps = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n * p))
                long = stats.transpose(1, 0, 2, 3).reshape(-1, len(STATS))
                yield pa.RecordBatch.from_arrays([parts.cast(pa.string()), orders, steps, *(pa.array(np.ascontiguousarray(long[:, i])) for i in range(len(STATS)))], names=[part, "filter_order", "step", *STATS])

    return counts.select(part, "cells").mapInArrow(run, columns)


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters over docs, in parts by source.

    A: under 200 words; B: fewer than half of the words are different; C: over
    2 % capitals; D: a sign of #$%&*|; E: the text of a smaller doc_id.

    Null texts and sources count as empty. A row without doc_id has no label,
    is never a copy and makes no other row one; rows that repeat a doc_id are
    no copies of each other. Of several labels of a document, any 1 counts.
    Only a digest of each text moves, never a text. Other columns, whatever
    their names, are ignored; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    read = docs.select("doc_id", text.alias("text"), F.coalesce("source", F.lit("")).alias("part")).withColumn("words", words)
    n = F.size("words")
    fails = [n < 200, 100 * F.size(F.array_distinct("words")) < 50 * n, 100 * F.regexp_count("text", F.lit("[A-Z]")) > 2 * F.length("text"), F.col("text").rlike("[#$%&*|]")]
    bits = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    # rows without an id are dealt out by their text, as no label can meet them
    digest = read.select("doc_id", "part", F.md5(F.col("text").cast("binary")).alias("text_id"), bits.alias("mask")).withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("text_id")).otherwise(F.lit(0)))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    marked = digest.join(known.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left").fillna(0, ["good", "toxic"])
    # one row for each document, as an id may be repeated
    each = marked.groupBy("doc_id", "spread", "text_id", "mask", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    # of a group of copies one row for each text, part and task moves; the rows of a text's least id are those that don't fail E
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", "good", "toxic"))).alias("least")
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless")
    texts = each.groupBy("text_id", "mask", "part").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"), least, nameless)
    is_least = F.col("least.doc_id") == F.min("least.doc_id").over(Window.partitionBy("text_id"))
    first = {c: F.when(is_least, F.col(f"least.{c}")).otherwise(0) + (F.col("nameless") if c == "n" else 0) for c in ("n", "good", "toxic")}
    texts = texts.select("part", "mask", "n", "good", "toxic", *(x.alias(f"first_{c}") for c, x in first.items()))
    kept = F.struct("mask", *(F.col(f"first_{c}").alias(c) for c in first))
    copies = F.struct((F.col("mask") + 16).alias("mask"), *((F.col(c) - F.col(f"first_{c}")).alias(c) for c in first))
    masked = texts.select("part", F.explode(F.array(kept, copies)).alias("x")).select("part", "x.*").where("n > 0")
    return audit(failure_counts(masked, "part", "mask", "n", "good", "toxic"), "part", "ABCDE")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


AUDIT_SQL = r"""
with marks as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels where doc_id is not null group by 1),
d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as part from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words, min(doc_id) over (partition by t) as least from d),
m as (select w.part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    cast(len(words) < 200 as int) + 2 * cast(100 * len(list_distinct(words)) < 50 * len(words) as int)
    + 4 * cast(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) as int)
    + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(coalesce(w.doc_id > least, false) as int) as mask
  from w left join marks using (doc_id)),
cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
l as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
orders as (select [a, b, c, d, e] as o, a.letter || b.letter || c.letter || d.letter || e.letter as filter_order
  from l a, l b, l c, l d, l e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (select filter_order, step, o[step].bit as own, coalesce(list_sum(list_transform(o[1:step - 1], lambda x: x.bit)), 0)::int as earlier
  from orders, (select unnest([1, 2, 3, 4, 5])::int as step)),
r as (select part, filter_order, step, own,
    coalesce(sum(n) filter (mask & (earlier | own) = 0), 0) as kept,
    coalesce(sum(n) filter (mask & earlier = 0 and mask & own <> 0), 0) as removed,
    coalesce(sum(n) filter (mask & earlier <> 0 and mask & own <> 0), 0) as redundant,
    coalesce(sum(n) filter (mask = own), 0) as unique_fails,
    coalesce(sum(good) filter (mask & earlier = 0 and mask & own <> 0), 0) as good_lost,
    coalesce(sum(toxic) filter (mask & earlier = 0 and mask & own <> 0), 0) as toxic_lost
  from cells, steps group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from r
"""

QUERIES = {"op13_filter_audit": op13_filter_audit}
SQL = {"op13_filter_audit": AUDIT_SQL}
