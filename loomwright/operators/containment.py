"""Passages that stand inside longer texts: seeds of rare trigrams, extension to a span, sentence edges, covers by fragments."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from loomwright.functions.text import words
from loomwright.sources.shared import new_path

#: Trigrams of all passages that may be broadcast (8 bytes each); more are joined by shuffle.
SMALL_GRAMS = 1_000_000


@dataclass(frozen=True)
class Containment:
    """share of a passage's trigrams and words that its span must hold; least trigrams of a passage; longest: length of a span against the passage's; edge: words that may be missing at either end, and that a span may grow to reach a sentence's edge."""

    share: float = 0.85
    least: int = 20
    longest: float = 1.15
    edge: int = 3
    block: int = 3


def sentences(text: Column) -> Column:
    """Array of the folded words of each sentence; sentences end at a stop, a closing mark or a line end. Sentences without words are left out."""
    parts = F.split(text, r"(?<=[.!?»”])\s+|\n+")
    return F.filter(F.transform(parts, words), lambda w: F.size(w) > 0)


def _grams(word_array: Column) -> Column:
    """Hashes of the different runs of three words."""
    one = lambda w, i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))
    # the words are bound once as the only member of an array, else they are made again for each run
    runs = lambda w: F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: one(w, i))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.element_at(F.transform(F.array(word_array), runs), 1))


def best_window(gram_at: list[tuple[int, object]], width: int) -> tuple[int, int]:
    """(start, different grams) of the window of `width` places with most different grams; the first on a tie. gram_at: (place, gram) in order."""
    inside: Counter = Counter()
    best, left = (0, 0), 0
    for at, gram in gram_at:
        inside[gram] += 1
        while gram_at[left][0] <= at - width:
            gone = gram_at[left][1]
            inside[gone] -= 1
            if not inside[gone]:
                del inside[gone]
            left += 1
        if len(inside) > best[1]:
            best = (gram_at[left][0], len(inside))
    return best


def find_span(passage: list[str], text: list[list[str]], p: Containment) -> tuple[int, int, float, bool] | None:
    """(first word, end, share of the passage's words, whether the span begins and ends with sentences) of a passage in a text of sentences, or None.

    The window with most of the passage's trigrams is aligned with the passage
    by common runs of words; what is missing at either end of the passage is
    added to the span, and the span grows over a few words to a sentence's edge.
    """
    flat = [w for s in text for w in s]
    n = len(passage)
    wanted = {tuple(passage[i : i + 3]) for i in range(n - 2)}
    if len(wanted) < p.least:
        return None
    width = math.floor(p.longest * n)
    hits = [(i, g) for i in range(len(flat) - 2) if (g := tuple(flat[i : i + 3])) in wanted]
    start, found = best_window(hits, max(width - 2, 1))
    if found < p.share * len(wanted):
        return None
    window = flat[start : start + width]
    blocks = [b for b in SequenceMatcher(None, passage, window, autojunk=False).get_matching_blocks() if b.size >= p.block]
    same = sum(b.size for b in blocks)
    if not blocks or same < p.share * n or blocks[0].a > p.edge or n - (blocks[-1].a + blocks[-1].size) > p.edge:
        return None
    first = max(start + blocks[0].b - blocks[0].a, 0)
    end = min(start + blocks[-1].b + blocks[-1].size + (n - blocks[-1].a - blocks[-1].size), len(flat))
    if end - first > width:
        return None
    edges = [0]
    for s in text:
        edges.append(edges[-1] + len(s))
    opens = max(e for e in edges if e <= first)
    closes = min(e for e in edges if e >= end)
    begins, finishes = first - opens <= p.edge, closes - end <= p.edge
    return (opens if begins else first), (closes if finishes else end), same / n, begins and finishes


def _staged(df: DataFrame, what: str) -> DataFrame:
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def contained(probes: DataFrame, probe_id: str, probe_words: str, texts: DataFrame, text_id: str, text_sentences: str, p: Containment = Containment()) -> DataFrame:
    """probe_id, text_id, first, end, share, whole_sentences: every text that holds a passage, all of them.

    probe_words: array of folded words; text_sentences: array of the words of
    each sentence. Ids are different; null arrays hold nothing. A text that has
    `share` of a passage's n trigrams has one of any n - ceil(share * n) + 1 of
    them; the rarest are taken as seeds, so frequent trigrams make no
    candidates, and every candidate is worked out. Texts move once, with the
    passages that may be in them; of all other texts only the places of the
    passages' trigrams are kept.
    """
    wanted = probes.select(F.col(probe_id).alias("probe"), F.col(probe_words).alias("words"), _grams(F.coalesce(probe_words, F.array().cast("array<string>"))).alias("grams")).where(F.size("grams") >= p.least)
    wanted = _staged(wanted, "passages")
    grams = wanted.select("probe", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    known = grams.select("gram").distinct()
    few = known.limit(SMALL_GRAMS + 1).count() <= SMALL_GRAMS
    hits = texts.select(F.col(text_id).alias("text"), F.explode(_grams(F.flatten(text_sentences))).alias("gram")).join(F.broadcast(known) if few else known, "gram", "left_semi")
    hits = _staged(hits, "seeds")
    often = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    ranked = grams.join(often, "gram", "left").withColumn("rank", F.row_number().over(Window.partitionBy("probe").orderBy(F.coalesce("texts", F.lit(0)), "gram")))
    seeds = ranked.where((F.col("rank") <= F.col("n") - F.ceil(F.lit(p.share) * F.col("n")) + 1) & F.col("texts").isNotNull()).select("probe", "gram")
    pairs = hits.join(seeds, "gram").select("text", "probe").distinct().join(wanted.select("probe", "words"), "probe")
    asked = pairs.groupBy("text").agg(F.collect_list(F.struct("probe", "words")).alias("asked"))
    rows = texts.select(F.col(text_id).alias("text"), F.col(text_sentences).alias("sentences")).join(asked, "text")
    schema = StructType([StructField(probe_id, probes.schema[probe_id].dataType), StructField(text_id, texts.schema[text_id].dataType), StructField("first", IntegerType()), StructField("end", IntegerType()), StructField("share", DoubleType()), StructField("whole_sentences", BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = (batch.column(2).type.value_type.field(0).type, batch.column(0).type, pa.int32(), pa.int32(), pa.float64(), pa.bool_())
            found = []
            for text, body, passages in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x in passages:
                    span = find_span(x["words"], body, p)
                    if span:
                        found.append((x["probe"], text, *span))
            columns = list(zip(*found, strict=True)) if found else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

    return rows.select("text", "sentences", "asked").mapInArrow(run, schema)


def fragment_cover(probes: DataFrame, probe_id: str, probe_sentences: str, texts: DataFrame, text_id: str, text_sentences: str, most: int = 3, p: Containment = Containment(least=10)) -> DataFrame:
    """probe_id, fragments: the first sentence, end and least text of each of at most `most` runs of sentences, one after the other, that cover a passage; passages without a cover have no row.

    From the first sentence on, the longest run that some text holds is taken.
    """
    body = probes.select(F.col(probe_id).alias("probe"), F.col(probe_sentences).alias("s")).where(F.size("s") > 0)
    n = F.size("s")
    spans = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    runs = body.select("probe", n.alias("n"), "s", F.explode(spans).alias("x")).select(F.struct("probe", "x.i", "x.j", "n").alias("run"), F.flatten(F.slice("s", F.col("x.i") + 1, F.col("x.j") - F.col("x.i"))).alias("words"))
    held = contained(runs, "run", "words", texts, text_id, text_sentences, p)
    longest = held.groupBy("run.probe", "run.n", "run.i").agg(F.min(F.struct((-F.col("run.j")).alias("j"), F.col(text_id).alias("text"))).alias("x"))
    steps = longest.groupBy("probe", "n").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("i", (-F.col("x.j")).alias("j"), F.col("x.text").alias("text"))))).alias("step"))
    at, taken = F.lit(0), []
    for _ in range(most):
        here = F.when(at < F.col("n"), F.try_element_at("step", at))
        taken.append(here)
        at = F.when(at < F.col("n"), here["j"]).otherwise(at)
    return steps.where(at == F.col("n")).select(F.col("probe").alias(probe_id), F.filter(F.array(*taken), lambda f: f.isNotNull()).alias("fragments"))

