"""Spelling variants: words one edit apart, by a positional q-gram index whose postings a heap merges.

A pair of words that one edit separates agrees outside some segment of the
longer one. Words travel to a bucket for each half that may hold the edit, as
members of their own length and as probes of the next length; a bucket with
too many rows is dealt anew by halves of its segment, until it is small, so no
task gets more than a bounded group and no pair is lost. In a bucket the
bigrams around the segment, with their positions, form an inverted index. A
probe's posting lists are merged by a heap that skips what can't reach the
overlap bound of one edit; what reaches it is verified.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import _LOWER, checked_broadcast, drop_tables, runs, span_hashes, spread_join, stage, string_blocks, table

#: Words of more bytes get their checksum one by one.
_TABLED = 64
#: The table of the checksum with the reflected polynomial 0xEDB88320.
_CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)


@dataclass(frozen=True)
class SpellingParameters:
    """Words of least_length code points and least_count occurrences; a form is `ratio` times as common; buckets hold at most bucket_rows."""

    least_length: int = 6
    least_count: int = 5
    ratio: int = 5
    damage: int | None = 199
    bucket_rows: int = 2048


# ---------------------------------------------------------------- words of a block


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0-U+00FF, whose UTF-8 form is C3 and one more byte."""
    lead = data == 0xC3
    inside = lead.copy()
    inside[1:] |= lead[:-1]
    low = data | 0x20
    return inside | ((low >= 97) & (low <= 122) & (data < 128))


def _shifted(crc: np.ndarray, most: int) -> np.ndarray:
    """The checksums as they stand after 0 to `most` zero bytes: crc(a + b) is shifted(crc(a), len(b)) ^ crc(b)."""
    out = np.zeros((most + 1, len(crc)), np.uint32)
    out[0] = crc
    for i in range(most):
        out[i + 1] = (out[i] >> np.uint32(8)) ^ _CRC[out[i] & np.uint32(255)]
    return out


def _block_words(data: np.ndarray, offsets: np.ndarray, ids: list[str], least: int, damage: int | None) -> Counter:
    """Words of at least `least` code points and how often they occur, after the damage."""
    starts, ends = runs(_letters(data), offsets)
    led = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 0xC3, out=led[1:])
    size = ends - starts
    points = size - (led[ends] - led[starts])
    long = points >= least
    starts, ends, size, points = starts[long], ends[long], size[long], points[long]
    found: Counter = Counter()
    if not len(starts):
        return found
    low = _LOWER[data]
    one, other = span_hashes(low, starts, ends), span_hashes(low, starts, ends, 1)
    _, first, kind = np.unique(one, return_index=True, return_inverse=True)
    if (other != other[first][kind]).any():  # two words with one hash
        _, first, kind = np.unique(np.stack([one, other], 1), axis=0, return_index=True, return_inverse=True)
    raw = low.tobytes()
    words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    hit = np.zeros(len(starts), bool)
    if damage:
        doc = np.searchsorted(offsets[1:], starts, "right")
        before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        checks = np.array([zlib.crc32(w) for w in words], np.uint32)
        short = size <= _TABLED
        crc = np.zeros(len(starts), np.uint32)
        after = _shifted(before, int(size[short].max(initial=0)))
        crc[short] = after[size[short], doc[short]] ^ checks[kind[short]]
        for i in np.flatnonzero(~short).tolist():
            crc[i] = zlib.crc32(words[kind[i]], int(before[doc[i]]))
        hit = crc % np.uint32(damage) == 0
        for i in np.flatnonzero(hit).tolist():
            word = words[kind[i]].decode()
            if len(word) > least:
                at = int(crc[i]) % len(word)
                found[word[:at] + word[at + 1 :]] += 1
    counts = np.bincount(kind[~hit], minlength=len(words))
    for word, n in zip(words, counts.tolist(), strict=True):
        if n:
            found[word.decode()] += n
    return found


def word_counts(docs: DataFrame, p: SpellingParameters) -> DataFrame:
    """word, n: the runs of letters of whole texts, A-Z lower-cased, that are long and frequent enough.

    With damage d, a run whose checksum with its document's id is a multiple
    of d loses one letter first. Counted by block and task before rows move.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, end, data, offsets in string_blocks(batch.column(1), 2 << 20):
                found = _block_words(data, offsets, ids[first:end], p.least_length, p.damage)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= p.least_count)


# ---------------------------------------------------------------- buckets


def _dealt(word: Column, size: Column, a: Column, b: Column, probe: int) -> Column:
    """The bucket of words of `size` letters that may differ in letters a to b - 1: its key holds all other letters. A probe has one letter less there."""
    key = F.concat_ws(":", size, F.concat(F.substring(word, F.lit(1), a), F.lit("\0"), F.substring(word, b + (1 - probe), size)))
    return F.struct(key.alias("key"), a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(probe).alias("probe"))


def _halves(size: Column, a: Column, b: Column) -> list[tuple[Column, Column]]:
    middle = F.floor((a + b) / 2)
    return [(a, middle), (middle, b)]


def _buckets(words: DataFrame, most: int) -> DataFrame:
    """key, a, b, probe, word, n of all buckets in which a pair may meet; none has more than `most` rows unless its segment is one letter long, where the alphabet bounds it."""
    size = F.length("word")
    routes = [_dealt(F.col("word"), size + probe, a, b, probe) for probe in (0, 1) for a, b in _halves(size + probe, F.lit(0), size + probe)]
    rows = words.select("word", "n", F.explode(F.array(*routes)).alias("x")).select("x.*", "word", "n")
    done = None
    while True:
        rows = stage(rows, "spelling-buckets")
        # a bucket needs a member, and another row
        counted = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("probe").alias("least"), F.max(F.col("b") - F.col("a")).alias("width")).where("rows > 1 and least = 0"), "spelling-counts")
        large = counted.where((F.col("rows") > most) & (F.col("width") > 1)).select("key")
        kept = rows.join(counted.where((F.col("rows") <= most) | (F.col("width") <= 1)).select("key"), "key", "left_semi")
        done = kept if done is None else done.unionByName(kept)
        if not large.limit(1).count():
            return done
        hot = rows.join(checked_broadcast(stage(large, "spelling-large")), "key", "left_semi")
        size, a, b = F.length("word") + F.col("probe"), F.col("a"), F.col("b")
        again = [F.when(F.col("probe") == probe, F.array(*[_dealt(F.col("word"), size, x, y, probe) for x, y in _halves(size, a, b)])) for probe in (0, 1)]
        rows = hot.select("word", "n", F.explode(F.coalesce(*again)).alias("x")).select("x.*", "word", "n")


# ---------------------------------------------------------------- within a bucket


def merge_postings(lists: list[tuple[list[int], int]], need: int) -> list[int]:
    """Members that stand in at least `need` (1 or more) of the sorted lists, each from its given place on.

    The heap holds the head of every list. If the least head isn't in enough
    of them, the need - 1 least lists leap to the next head: no member before
    it can be in enough lists.
    """
    heap = [(x[at], i, at) for i, (x, at) in enumerate(lists) if at < len(x)]
    heapq.heapify(heap)
    out = []
    while len(heap) >= need:
        least, taken = heap[0][0], []
        while heap and heap[0][0] == least:
            taken.append(heapq.heappop(heap))
        if len(taken) >= need:
            out.append(least)
            moved = [(i, at + 1) for _, i, at in taken]
        else:
            while heap and len(taken) < need - 1:
                taken.append(heapq.heappop(heap))
            if not heap:
                break
            head = heap[0][0]
            moved = [(i, bisect_left(lists[i][0], head, at)) for _, i, at in taken]
        for i, at in moved:
            if at < len(lists[i][0]):
                heapq.heappush(heap, (lists[i][0][at], i, at))
    return out


def bucket_pairs(members: list[str], probes: list[str], a: int, b: int) -> Iterator[tuple[int, int, bool]]:
    """(member, member, False) and (probe, member, True) that one edit inside the segment separates, each pair once over all segments.

    Members have equal lengths and differ only in letters a to b - 1; a probe
    lacks one of these. Of the b - a + 1 bigrams around the segment a
    replacement spoils two, at equal positions; of a probe's b - a bigrams an
    insertion spoils one, and moves those behind it by one place.
    """
    index: dict[tuple[int, str], list[int]] = {}
    for k, word in enumerate(members):
        padded = f"\1{word}\2"
        for i in range(a, b + 1):
            index.setdefault((i, padded[i : i + 2]), []).append(k)
    need = b - a - 1
    for k, word in enumerate(members):
        if need > 0:
            padded = f"\1{word}\2"
            lists = [index[i, padded[i : i + 2]] for i in range(a, b + 1)]
            near = merge_postings([(x, bisect_left(x, k + 1)) for x in lists], need)
        else:
            near = range(k + 1, len(members))
        own = word[a:b]
        for other in near:
            if sum(x != y for x, y in zip(own, members[other][a:b], strict=True)) == 1:
                yield k, other, False
    for k, word in enumerate(probes):
        if need > 0:
            padded = f"\1{word}\2"
            lists = [x for i in range(a, b) for at in (i, i + 1) if (x := index.get((at, padded[i : i + 2])))]
            near = merge_postings([(x, 0) for x in lists], need)
        else:
            near = range(len(members))
        for other in near:
            longer = members[other]
            at = next((i for i, (x, y) in enumerate(zip(word, longer, strict=False)) if x != y), len(word))
            # the last place where the letter may have come in decides which segment reports the pair
            if a <= at < b and word[at:] == longer[at + 1 :]:
                yield k, other, True


def _pairs_of_rows(rows: list[tuple[int, int, int, str, int]]) -> list[tuple[str, int, str, int]]:
    """Both directions of the pairs of one bucket; rows: a, b, probe, word, n."""
    rows.sort(key=lambda r: (r[2], r[3]))
    cut = sum(r[2] == 0 for r in rows)
    members, probes = rows[:cut], rows[cut:]
    out = []
    if members:
        for i, j, probed in bucket_pairs([r[3] for r in members], [r[3] for r in probes], rows[0][0], rows[0][1]):
            x, y = (probes if probed else members)[i], members[j]
            out += [(x[3], x[4], y[3], y[4]), (y[3], y[4], x[3], x[4])]
    return out


def near_words(words: DataFrame, p: SpellingParameters) -> DataFrame:
    """word, n, near, near_n: both directions of every pair of different words that one inserted, deleted or replaced code point separates."""
    spread = _buckets(words, p.bucket_rows).repartition("key").sortWithinPartitions("key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        key, rows, out = None, [], []

        def send() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            sent = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2, strict=True)], names=["word", "n", "near", "near_n"])
            out.clear()
            return sent

        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if len(rows) > 1:
                        out += _pairs_of_rows(rows)
                        if len(out) > 20_000:
                            yield send()
                    key, rows = k, []
                rows.append(tuple(row))
        if len(rows) > 1:
            out += _pairs_of_rows(rows)
        yield send()

    return spread.select("key", "a", "b", "probe", "word", "n").mapInArrow(run, "word string, n long, near string, near_n long")


# ---------------------------------------------------------------- forms


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms from each word that has one. A form is several times as common, so chains are short and have no circles; each round halves what is left of them."""
    roots = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        links = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(spread_join(roots, links, "root"), "spelling-steps")
        if not moved.where("next is not null").limit(1).count():
            return roots
        roots = stage(moved.select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def variants(docs: DataFrame, p: SpellingParameters | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the documents.

    n_near counts the words one edit away. form is the most common of them
    (ties: the smallest in code-point order) if it is `ratio` times as common
    as the word, else null; root is the end of the chain of forms, the word
    itself where it has none.

    Null and empty texts have no words; a null doc_id reads as the empty
    string; repeated rows count again; texts and runs of any length are read
    whole. An empty table gives no rows, other columns are ignored.
    """
    p = p or SpellingParameters()
    words = stage(word_counts(docs, p), "spelling-words")
    pairs = near_words(words, p)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("x"))
    whole = words.join(best, "word", "left")
    common = -F.col("x.m") >= p.ratio * F.col("n")
    whole = whole.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(common, F.col("x.near")).alias("form"), F.when(common, -F.col("x.m")).alias("form_n"))
    whole = stage(whole, "spelling-forms")
    roots = _roots(whole.where("form is not null"))
    return whole.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


VARIANT_SQL = r"""
with recursive bits as (select cast(i as ubigint) as i, cast(i as ubigint) as c, 0 as k from range(256) r(i)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from bits where k < 8),
crc as (select list(c order by i) as t from bits where k = 8),
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
counted as (select doc_id, run, count(*) as n from runs where length(run) >= 6 group by all),
bytes as (select *, list_prepend(4294967295::ubigint, list_transform(
    flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)] else [195, unicode(c) - 64] end)), lambda b: cast(b as ubigint))) as b from counted),
hashed as (select run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[cast(xor(c, x) & 255 as bigint) + 1])), 4294967295::ubigint) as h from bytes, crc),
damaged as (select case when h % 199 = 0 then left(run, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, n, h from hashed),
words as (select word, cast(sum(n) as bigint) as n, length(word) as l,
    translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~') as one_byte
  from damaged where length(word) >= 6 group by word having sum(n) >= 5),
near as (select a.word, a.n, b.word as near, b.n as near_n from words a join words b on a.word <> b.word and abs(a.l - b.l) <= 1 and levenshtein(a.one_byte, b.one_byte) = 1),
best as (select word, count(*) as n_near, arg_min(near, row(-near_n, near)) as near, max(near_n) as near_n from near group by 1),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 5 * w.n then near end as form, case when near_n >= 5 * w.n then near_n end as form_n
  from words w left join best using (word)),
chain as (select word, word as here, 0 as steps from forms union all select c.word, f.form, steps + 1 from chain c join forms f on f.word = c.here where f.form is not null)
select f.word, n, n_near, form, form_n, root from forms f join (select word, arg_max(here, steps) as root from chain group by 1) using (word)
"""

QUERIES = {"op11_spelling": op11_spelling}
SQL = {"op11_spelling": VARIANT_SQL}
