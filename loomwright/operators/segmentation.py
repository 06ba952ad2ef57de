"""Words put together again from text that lost its spaces, by costs learned from text that has them."""

from __future__ import annotations

import functools
import math
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StringType, StructField, StructType

#: The most frequent words, which are broadcast (about 100 MB in a task); rarer ones are looked up by a join.
SMALL_WORDS = 4_000_000
#: Sizes of the filter of all words and what they begin with: 32 bits a word between these; 64 MB at most, beyond which more pieces than words are joined.
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 29
#: Code points that are read at once, letters that are cut at once, and the longest run of letters that is cut beside others.
READ_AT_ONCE, CUT_AT_ONCE, LONGEST_RUN = 1 << 20, 1 << 17, 256


@dataclass(frozen=True)
class Costs:
    """What it costs to begin a word, the longest word tried, and the cost of each letter of a word that isn't known."""

    begin: float = 2.0
    longest: int = 22
    unknown_letter: float = 3.2


def is_spaced(line: Column, least: int = 10, share: float = 0.8) -> Column:
    """Whether a line is set letter by letter: at least `least` pieces of one character, and that share of all pieces."""
    pieces = F.filter(F.split(F.trim(line), " "), lambda p: p != "")
    single = F.size(F.filter(pieces, lambda p: F.length(p) == 1))
    return (single >= least) & (single >= share * F.size(pieces))


def word_costs(lines: DataFrame, line: str, costs: Costs = Costs()) -> DataFrame:
    """word (lower case, of letters), n, total, cost: begin - ln(n / total), from the lines that aren't spaced. Counted in the tasks first."""
    words = lines.where(~is_spaced(F.col(line))).select(F.explode(F.regexp_extract_all(line, F.lit(r"([\p{L}]+)"), 1)).alias("word")).select(F.lower("word").alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # beside the counts in one plan, so that the words are counted once
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(1)).cast("long").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("word", "n", "total", (F.lit(costs.begin) - F.log(F.col("n") / F.col("total").cast("double"))).alias("cost"))


def _with(rows: DataFrame, **more: DataType) -> StructType:
    return StructType([*rows.schema.fields, *(StructField(n, t) for n, t in more.items())])


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


Hits = Callable[[str, int, int], Iterable[tuple[int, float]]]


def best_cut(line: str, hits: Hits, log_total: float, costs: Costs) -> list[tuple[int, int]]:
    """The parts of the cheapest way to read a line without spaces; hits(low, i, end) are the ends, up to `end`, and costs of the known words that begin at i.

    Digits stay together and other signs stand alone, at no cost. A word that
    isn't known costs as much as one seen once, and more with each letter. Of
    equally cheap ways the one whose last part is longer wins.
    """
    n, low = len(line), _lower(line)
    best, back = [math.inf] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    first, letter = costs.begin + log_total, costs.unknown_letter
    i = 0
    while i < n:
        if not line[i].isalpha():
            j = i + 1
            if line[i].isdigit():
                while j < n and line[j].isdigit():
                    j += 1
            best[j], back[j] = best[i], i
            i = j
            continue
        end = i
        while end < n and line[end].isalpha():
            end += 1
        # of the places where a word that isn't known may have begun, those that may still be the cheapest, cheapest first
        begun: deque[tuple[float, int]] = deque()
        for at in range(i, end):
            here = best[at]
            if at > i and begun:
                while begun[0][1] < at - costs.longest:
                    begun.popleft()
                start = begun[0][1]
                unseen = best[start] + first + (at - start) * letter
                if unseen < here or (unseen == here and start < back[at]):
                    here = best[at] = unseen
                    back[at] = start
            level = here - at * letter
            while begun and begun[-1][0] > level:
                begun.pop()
            begun.append((level, at))
            for j, cost in hits(low, at, min(end, at + costs.longest)):
                if here + cost < best[j]:
                    best[j], back[j] = here + cost, at
        while begun[0][1] < end - costs.longest:
            begun.popleft()
        start = begun[0][1]
        unseen = best[start] + first + (end - start) * letter
        if unseen < best[end] or (unseen == best[end] and start < back[end]):
            best[end], back[end] = unseen, start
        i = end
    parts, j = [], n
    while j:
        parts.append((back[j], j))
        j = back[j]
    return parts[::-1]


def hits_of(cost: dict[str, float]) -> Hits:
    """hits() of a small vocabulary, looked up piece by piece; no piece longer than the longest word with the same first letters is looked at."""
    reach: dict[str, int] = {}
    for word in cost:
        reach[word[:3]] = max(reach.get(word[:3], 0), len(word))
    get, far = cost.get, reach.get

    def hits(low: str, i: int, end: int) -> list[tuple[int, float]]:
        longest = far(low[i : i + 3]) or 2
        return [(j, c) for j in range(i + 1, min(end, i + longest) + 1) if (c := get(low[i:j])) is not None]

    return hits


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _longer(hashes: np.ndarray, code: np.ndarray, by: int) -> np.ndarray:
    """Hashes of pieces that are longer by one code point."""
    mixed = hashes * np.uint64(by)
    mixed += code
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    return mixed


#: Two hashes tell words apart.
ONE, TWO = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D


def _two_bits(hashes: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a word in a filter of n_bits (a power of two)."""
    mask = np.uint64(n_bits - 1)
    return hashes & mask, ((hashes >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & mask


def _first_bit(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """The place in a filter of n_bits of what words begin with."""
    return (hashes >> np.uint64(17)) & np.uint64(n_bits - 1)


def _in(known: np.ndarray, bit: np.ndarray) -> np.ndarray:
    # as signed numbers, which numpy takes as places without a copy
    return (known[(bit >> np.uint64(3)).view(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).view(bool)


def _by_size(words: Iterable[str]) -> Iterator[tuple[list[str], list[np.ndarray], np.ndarray]]:
    """Words of one size, the first hashes of their first 1, 2, ... code points, and their second hashes."""
    by_size: dict[int, list[str]] = {}
    for word in words:
        by_size.setdefault(len(word), []).append(word)
    for n, group in by_size.items():
        codes = _code_points("".join(group)).astype(np.uint64).reshape(len(group), n)
        ones, two = [], np.zeros(len(group), np.uint64)
        for k in range(n):
            ones.append(_longer(ones[-1] if ones else two, codes[:, k], ONE))
            two = _longer(two, codes[:, k], TWO)
        yield group, ones, two


def _fitting(words: DataFrame, longest: int) -> DataFrame:
    return words.where((F.length("word") > 0) & (F.length("word") <= longest))


def _filter_of(words: DataFrame, n_words: int, longest: int) -> np.ndarray:
    """A filter of at most MOST_BITS that lets all words and what they begin with through and little else, put together in the tasks and sent as its filled buckets."""
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * n_words).bit_length()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [b for _, ones, _ in _by_size(batch.column(0).to_pylist()) for b in (*_two_bits(ones[-1], n_bits), *(_first_bit(h, n_bits) for h in ones))]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(bits or [np.zeros(0, np.uint64)])).astype(np.int64))], names=["bit"])

    bits = _fitting(words.select("word"), longest).mapInArrow(run, "bit long").select((F.col("bit") + 1).alias("bit"))
    parts = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("part")).toArrow()
    found = np.zeros(n_bits // 8, np.uint8)
    for bucket, part in zip(parts.column(0).to_pylist(), parts.column(1), strict=True):
        part = np.frombuffer(part.as_buffer(), np.uint8)
        found[(bucket - 1) * len(part) : bucket * len(part)] = part
    return found


@dataclass(frozen=True)
class _Table:
    """Costs of words, found by their two hashes: those whose second hash begins with b stand from begin[b] to begin[b + 1]; an empty place ends all."""

    one: np.ndarray
    cost: np.ndarray
    begin: np.ndarray
    shift: int

    @staticmethod
    def of(one: np.ndarray, two: np.ndarray, cost: np.ndarray) -> _Table:
        bits = max(len(one), 1).bit_length() + 1
        bucket = two.astype(np.uint64) >> np.uint64(64 - bits)
        order = np.argsort(bucket, kind="stable")
        begin = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount(bucket.astype(np.int64), minlength=1 << bits), out=begin[1:])
        return _Table(np.append(one.astype(np.uint64)[order], np.uint64(0)), np.append(cost[order], np.nan), begin, 64 - bits)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Costs of words with these hashes, NaN where there is none."""
        bucket = (two >> np.uint64(self.shift)).view(np.int64)
        at, to = self.begin[bucket], self.begin[bucket + 1]
        # most stand first in their bucket
        same = (self.one[at] == one) & (at < to)
        found = np.where(same, self.cost[at], np.nan)
        where = np.flatnonzero(~same)
        while len(where := where[at[where] + 1 < to[where]]):
            at[where] += 1
            same = self.one[at[where]] == one[where]
            found[where[same]] = self.cost[at[where[same]]]
            where = where[~same]
        return found


def _hashed(words: DataFrame, longest: int) -> DataFrame:
    """one, two, cost: words as their two hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for group, ones, two in _by_size(cost):
                yield pa.RecordBatch.from_arrays([pa.array(ones[-1].view(np.int64)), pa.array(two.view(np.int64)), pa.array([cost[w] for w in group])], names=["one", "two", "cost"])

    return _fitting(words.select("word", "cost"), longest).mapInArrow(run, "one long, two long, cost double")


def _table_of(words: DataFrame, longest: int) -> _Table:
    """The table of a bounded number of words."""
    got = _hashed(words, longest).toArrow()
    return _Table.of(*(got.column(k).to_numpy() for k in range(3)))


@dataclass(frozen=True)
class _Known:
    """What each task has of the vocabulary: the frequent words and the filter of all."""

    often: _Table
    filter: np.ndarray
    log_total: float


def _may_be(signs: np.ndarray, at: np.ndarray, known: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of 1, 2, ... code points that the filter lets through: how many, where they begin and their two hashes.

    signs ends with `longest` zeros; no piece has one, and none is looked at
    that goes on where no word begins so.
    """
    one = two = np.zeros(len(at), np.uint64)
    for n in range(1, longest + 1):
        code = signs[at + (n - 1)]
        one = _longer(one, code, ONE)
        on = np.flatnonzero(_in(known, _first_bit(one, 8 * len(known))) & (code != 0))
        if not len(on):
            return
        at, one, two = at[on], one[on], _longer(two[on], code[on], TWO)
        first, second = _two_bits(one, 8 * len(known))
        word = np.flatnonzero(_in(known, first))
        word = word[_in(known, second[word])]
        yield n, at[word], one[word], two[word]


def _spots(low: str, known: np.ndarray, longest: int) -> tuple[list[int], list[int]]:
    """Where pieces of a text that the filter lets through begin, in order, and their ends, shorter first."""
    signs = np.concatenate([_code_points(low).astype(np.uint64), np.zeros(longest, np.uint64)])
    spots = sorted((i, i + n) for n, at, _, _ in _may_be(signs, np.arange(len(low)), known, longest) for i in at.tolist())
    return [i for i, _ in spots], [j for _, j in spots]


def _hits(signs: np.ndarray, at: np.ndarray, known: _Known, own: _Table | None, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Words by their size: where they begin and their costs."""
    for n, begin, one, two in _may_be(signs, at, known.filter, longest):
        cost = known.often.find(one, two)
        if own is not None and len(lacks := np.flatnonzero(np.isnan(cost))):
            cost[lacks] = own.find(one[lacks], two[lacks])
        is_word = np.flatnonzero(~np.isnan(cost))
        yield n, begin[is_word], cost[is_word]


@functools.cache
def _kinds() -> np.ndarray:
    """By code point: 1 a letter, 2 a digit, 0 another sign."""
    return np.fromiter((c.isalpha() + 2 * c.isdigit() for c in map(chr, range(0x110000))), np.uint8, 0x110000)


def _lower_lines(text: str) -> str:
    return "\n".join(_lower(line) for line in text.split("\n"))


@dataclass(frozen=True)
class _Read:
    """A text: its kinds of signs, its letters in lower case (0 for other signs, and at its end), and where its runs of letters begin and end."""

    kinds: np.ndarray
    signs: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @staticmethod
    def of(text: str, longest: int) -> _Read:
        kinds = _kinds()[_code_points(text)]
        letters = kinds == 1
        signs = np.zeros(len(text) + longest, np.uint64)
        np.copyto(signs[: len(text)], _code_points(_lower_lines(text)), where=letters)
        edges = np.flatnonzero(np.diff(letters.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        return _Read(kinds, signs, edges[::2], edges[1::2])


def _at_once(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbours of at most that size together, or one larger one."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        yield slice(begin, end)
        begin = end


def _each(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers from each begin on, as many as its size."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def _side_by_side(begin: np.ndarray, size: np.ndarray, hits: Iterable[tuple[int, np.ndarray, np.ndarray]], log_total: float, costs: Costs, near: float) -> tuple[np.ndarray, np.ndarray]:
    """best_cut() of many runs of letters, a letter of all at a time: where words begin; runs where another way is within `near` of the cheapest.

    cells has for the k-th letters of all runs, by the longest run, the costs
    of the words that end there, the longest first.
    """
    longest = costs.longest
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    n_runs, most = len(size), int(size[0])
    wide = n_runs - np.searchsorted(size[::-1], np.arange(most), "right")
    cell = longest * np.concatenate([[0], np.cumsum(wide)])
    cells = np.empty(cell[-1])
    unknown = costs.begin + log_total + costs.unknown_letter * np.arange(longest, 0, -1)[:, None]
    for k in range(most):
        cells[cell[k] : cell[k + 1]].reshape(longest, -1)[:] = unknown
    first = int(begin.min())
    run_at = np.zeros(int((begin + size).max()) - first, np.int64)
    run_at[_each(begin - first, size)] = np.repeat(np.arange(n_runs), size)
    for n, at, cost in hits:
        run = run_at[at - first]
        last = at - begin[run] + (n - 1)
        cells[cell[last] + (longest - n) * wide[last] + run] = cost
    best = np.empty((longest + most, n_runs))
    best[: longest - 1], best[longest - 1] = np.inf, 0.0
    for k in range(most):
        here = cells[cell[k] : cell[k + 1]].reshape(longest, -1)
        here += best[k : k + longest, : wide[k]]
        here.min(axis=0, out=best[longest + k, : wide[k]])
    cuts, doubtful = [], np.zeros(n_runs, bool)
    run, end = np.arange(n_runs), size.copy()
    while len(run):
        ways = cells[cell[end - 1] + run + np.arange(longest)[:, None] * wide[end - 1]]
        way = ways.argmin(axis=0)
        cheapest = np.take_along_axis(ways, way[None], 0)[0]
        doubtful[run[(ways <= cheapest + near).sum(axis=0) > 1]] = True
        end = end - (longest - way)
        cuts.append(begin[run] + end)
        run, end = run[end > 0], end[end > 0]
    back = np.empty(n_runs, bool)
    back[order] = doubtful
    return np.concatenate(cuts), back


def _beginnings(text: str, known: _Known, own: _Table | None, costs: Costs) -> np.ndarray:
    """Whether a part begins, for each code point of a text.

    Short runs of letters are cut beside each other, from a cost of 0 each.
    Where two ways differ by no more than rounding may, or a run is long, its
    line is cut by best_cut().
    """
    read = _Read.of(text, costs.longest)
    begins = read.kinds != 1
    begins[1:] &= (read.kinds[1:] != 2) | (read.kinds[:-1] != 2)
    begins[read.begin] = True
    ends = np.concatenate([np.flatnonzero(_code_points(text) == 10), [len(text)]])
    line, size = np.searchsorted(ends, read.begin), read.end - read.begin
    again = np.zeros(len(ends), bool)
    again[line[size > LONGEST_RUN]] = True
    short = np.flatnonzero(size <= LONGEST_RUN)
    for some in _at_once(size[short], CUT_AT_ONCE):
        runs = short[some]
        hits = _hits(read.signs, _each(read.begin[runs], size[runs]), known, own, costs.longest)
        cuts, doubtful = _side_by_side(read.begin[runs], size[runs], hits, known.log_total, costs, 1e-12 * max(len(text), 1e6))
        begins[cuts] = True
        again[line[runs[doubtful]]] = True
    lines = np.flatnonzero(again)
    starts = np.where(lines > 0, ends[lines - 1] + 1, 0)
    for some in _at_once(ends[lines] - starts, CUT_AT_ONCE):
        runs = np.flatnonzero(np.isin(line, lines[some]))
        hits = [(at, np.full(len(at), n), cost) for n, at, cost in _hits(read.signs, _each(read.begin[runs], size[runs]), known, own, costs.longest)]
        at, n, cost = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else [np.zeros(0, np.int64)] * 3
        order = np.argsort(at, kind="stable")
        at, n, cost = at[order], n[order], cost[order]
        for start, end in zip(starts[some].tolist(), ends[lines[some]].tolist(), strict=True):
            its = np.searchsorted(at, np.arange(start, end + 1))
            here = slice(its[0], its[-1])
            its, to, paid = (its - its[0]).tolist(), (at[here] + n[here] - start).tolist(), cost[here].tolist()
            # all end in the run in which they begin
            parts = best_cut(text[start:end], lambda _, i, end: zip(to[its[i] : its[i + 1]], paid[its[i] : its[i + 1]]), known.log_total, costs)  # noqa: B023, B905
            begins[start:end] = False
            begins[[start + i for i, _ in parts]] = True
    return begins


def _parts(texts: list[str | None], known: _Known, own: _Table | None, costs: Costs) -> pa.ListArray:
    """The parts of some texts; as they make up each text, their bytes are those of the texts."""
    whole = [t for t in texts if t is not None]
    begins = _beginnings("\n".join(whole), known, own, costs) if whole else np.zeros(0, bool)
    sizes = np.array([len(t) for t in whole], np.int64)
    begins = begins[_each(np.cumsum(sizes + 1) - sizes - 1, sizes)]
    text = "".join(whole)
    codes = _code_points(text)
    at = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000), dtype=np.int32)]).astype(np.int32)
    offsets = np.append(at[:-1][begins], at[-1]).astype(np.int32)
    values = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(text.encode()))
    null = np.array([t is None for t in texts], bool)
    ends = np.zeros(len(texts), np.int64)
    ends[~null] = sizes
    counted = np.concatenate([[0], np.cumsum(begins)])
    lists = np.concatenate([[0], counted[np.cumsum(ends)]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), values, mask=pa.array(null))


def segment(rows: DataFrame, text: str, vocabulary: DataFrame, costs: Costs = Costs(), small: int = SMALL_WORDS, true: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """rows (or the columns `keep` of them) with `parts`: the words, numbers and signs of a text without spaces, in order; line ends are parts of their own. Null: null.

    With `true`, the true parts, there are the counts of cut_agreement() too.

    vocabulary is word_costs() as a staged table. Its most frequent words,
    `small` at most, go to the tasks, with a filter of bounded size that tells
    which pieces of a text may be words at all. Pieces that may be one of the
    rarer words are joined with those by their hashes, and each text gets its
    own of them; so a task holds the rare words of its texts and never the
    vocabulary.
    """
    spark = rows.sparkSession
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        rows = rows.repartition(spark.sparkContext.defaultParallelism)  # a small input in few files
    # there are few different counts: n of them need a text of n * n / 2 words
    counts = sorted(vocabulary.groupBy("n").agg(F.count(F.lit(1)).alias("words"), F.max("total").alias("total")).collect(), key=lambda r: -r.n)
    n_words, least = 0, math.inf
    for r in counts:
        n_words += r.words
        if n_words <= small:
            least = r.n
    log_total = math.log(counts[0].total) if counts else 0.0
    often = vocabulary.where(F.col("n") >= least) if counts and least < math.inf else vocabulary.limit(0)
    shared = spark.sparkContext.broadcast(_Known(_table_of(often, costs.longest), _filter_of(vocabulary, n_words, costs.longest), log_total))
    keep = rows.columns if keep is None else keep
    if n_words <= small:
        return _cut(rows, text, None, true, keep, shared, costs)
    rare = vocabulary.where(F.col("n") < least) if least < math.inf else vocabulary

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for some in _at_once(np.array([len(t) for t in texts]), READ_AT_ONCE):
                text = "\n".join(texts[some])
                read = _Read.of(text, costs.longest)
                begins = np.cumsum([0, *(len(t) + 1 for t in texts[some])])
                keys = batch.column(0).to_numpy()[some]
                for runs in _at_once(read.end - read.begin, CUT_AT_ONCE):
                    for _, at, one, two in _may_be(read.signs, _each(read.begin[runs], (read.end - read.begin)[runs]), known.filter, costs.longest):
                        lacks = np.flatnonzero(np.isnan(known.often.find(one, two)))
                        row = keys[np.searchsorted(begins, at[lacks], "right") - 1]
                        asked = np.stack([row, one[lacks].view(np.int64), two[lacks].view(np.int64)])
                        asked = asked[:, np.lexsort(asked)]
                        asked = asked[:, np.append(True, (asked[:, 1:] != asked[:, :-1]).any(axis=0))[: len(lacks)]]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in asked], names=["__id", "one", "two"])

    # two texts of one hash get each other's words too, which changes nothing: all are words, and those that they lack go unused
    asked = rows.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("__id"), F.col(text).alias("__text")).mapInArrow(run, "__id long, one long, two long").distinct()
    own = asked.join(_hashed(rare, costs.longest), ["one", "two"]).groupBy("__id").agg(F.collect_list(F.struct("one", "two", "cost")).alias("__own"))
    joined = rows.withColumn("__id", F.xxhash64(text)).join(own, "__id", "left").select(*rows.columns, "__own")
    return _cut(joined, text, F.col("__own"), true, keep, shared, costs)


COUNTS = ["n_found", "n_true", "n_right"]


def _cut(rows: DataFrame, text: str, own: Column | None, true: Column | None, keep: list[str], shared: Broadcast, costs: Costs) -> DataFrame:
    """The columns `keep` of rows with parts, and counts if there are true parts. own: a text's rare words, hashes and cost."""
    n, has_own, has_true = len(keep), own is not None, true is not None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(n).to_pylist()
            for some in _at_once(np.array([len(t or "") for t in texts], np.int64), READ_AT_ONCE):
                here = batch.slice(some.start, some.stop - some.start)
                rare = _Table.of(*(x.to_numpy() for x in here.column(n + 1).flatten().flatten())) if has_own else None
                parts = _parts(texts[some], known, rare, costs)
                counts = _agreement(parts, here.column(here.num_columns - 1)) if has_true else []
                yield pa.RecordBatch.from_arrays([*here.columns[:n], parts, *counts], names=[*keep, "parts", *(COUNTS if counts else [])])

    asked = rows.select(*keep, F.col(text).alias("__text"), *([] if own is None else [own.alias("__own")]), *([] if true is None else [true.alias("__true")]))
    return asked.mapInArrow(run, _with(rows.select(*keep), parts=ArrayType(StringType()), **({} if true is None else dict.fromkeys(COUNTS, LongType()))))


def _agreement(found: pa.ListArray, true: pa.ListArray) -> list[pa.Array]:
    """How many parts each row has in each, and how many ends of parts both have."""

    def ends(parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = pc.fill_null(pc.list_value_length(parts), 0).to_numpy().astype(np.int64)
        end = np.concatenate([[0], np.cumsum(pc.fill_null(pc.utf8_length(parts.flatten()), 0).to_numpy(), dtype=np.int64)])
        return n, np.repeat(np.arange(len(n)), n), end[1:] - np.repeat(end[np.cumsum(n) - n], n)

    (n_found, row, a), (n_true, row_b, b) = ends(found), ends(true)
    # the ends of each row have their own stretch of places
    most = np.zeros(len(found) + 1, np.int64)
    np.maximum.at(most, row + 1, a + 1)
    np.maximum.at(most, row_b + 1, b + 1)
    base = np.cumsum(most)
    in_both = np.zeros(base[-1] + 1, np.uint8)
    in_both[base[row] + a] = 1
    in_both[base[row_b] + b] |= 2
    right = np.diff(np.concatenate([[0], np.cumsum(in_both == 3)])[base])
    return [pa.array(c, pa.int64()) for c in (n_found, n_true, right)]


def cut_agreement(rows: DataFrame, found: str, true: str) -> DataFrame:
    """rows with n_found, n_true and n_right: cuts of two arrays of parts of one text, and how many stand at the same place. A null array has none."""
    at, to = rows.columns.index(found), rows.columns.index(true)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                yield pa.RecordBatch.from_arrays([*batch.columns, *_agreement(batch.column(at), batch.column(to))], names=[*batch.schema.names, *COUNTS])

    return rows.mapInArrow(run, _with(rows, **dict.fromkeys(COUNTS, LongType())))


def put_together(parts: Column) -> Column:
    """Parts as lines again: no blank before a closing sign or after an opening one, none around a hyphen."""
    text = F.array_join(parts, " ")
    text = F.regexp_replace(text, r" ?\n ?", "\n")
    text = F.regexp_replace(text, r" ([,.;:)\]!?”'-])", "$1")
    return F.regexp_replace(text, r"([(\[“-]) ", "$1")

