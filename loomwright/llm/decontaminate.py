"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are case-folded runs of letters and digits, features the shingles of
five words. Window sizes are a ladder; an item is indexed at the largest size
that fits it (its first, middle and last window) and at the largest that fits
half of it (first and last window), so an item edited in one place keeps an
untouched window. Every window of those sizes in every text has its 64-bit
SimHash taken, from running sums of packed bit counters. Two fingerprints
within RADIUS bits agree up to REACH bits in one of BLOCKS blocks, so the
lookup of all block values within REACH finds all of them. Around each
candidate window the span of the text with the greatest weighted (multiset)
Jaccard similarity to the whole item is then worked out, of any length, so
that words put in or left out cost no more than they should.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import checked_broadcast, drop_tables, letter_words, shingles, stage, string_blocks, table
from loomwright.llm.subwords import texts_block

SHINGLE = 5
#: Window sizes in shingles; longer items are indexed at the last.
LADDER = (1, 2, 3, 4, 5, 7, 9, 12, 16, 22, 30, 40, 54, 73, 98, 126)
BLOCKS, REACH = 4, 2
RADIUS = BLOCKS * (REACH + 1) - 1
#: Items of one pass over the texts; bounds what is broadcast.
BLOCK_ITEMS = 5_000
_SPREAD = np.array([sum(1 << (8 * i) for i in range(8) if b >> i & 1) for b in range(256)], np.uint64)
_HIGH = np.uint64(0x8080808080808080)
_GATHER = np.uint64(0x0102040810204080)


def counters(features: np.ndarray) -> np.ndarray:
    """Running sums of the features' bits: 8 rows of 8 packed counters; differences are exact for windows up to 126."""
    out = np.zeros((8, len(features) + 1), np.uint64)
    for k in range(8):
        np.cumsum(_SPREAD[(features >> np.uint64(8 * k)).astype(np.uint8)], out=out[k, 1:])
    return out


def fingerprints(sums: np.ndarray, w: int) -> np.ndarray:
    """SimHash of every window of w features: bit by bit whether more than half of them have it."""
    n = sums.shape[1] - w
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    lift = np.uint64((127 - w // 2) * 0x0101010101010101)
    for k in range(8):
        # a counter over half of w reaches the high bit of its byte
        over = ((sums[k, w:] - sums[k, :n] + lift) & _HIGH) >> np.uint64(7)
        out |= (over * _GATHER >> np.uint64(56)) << np.uint64(8 * k)
    return out


def _variants(value: int, bits: int) -> list[int]:
    out = [value]
    for r in range(1, REACH + 1):
        for some in combinations(range(bits), r):
            out.append(value ^ sum(1 << b for b in some))
    return out


class ItemIndex:
    """Items (id, features) with the block tables of their windows."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        data, offsets = texts_block([t for _, t in items])
        words, first = letter_words(data, offsets)
        self.k: list[int] = []
        self.features: list[np.ndarray] = []
        #: Different features of each item in ascending order, and how often it has them.
        self.sets: list[tuple[np.ndarray, np.ndarray]] = []
        windows: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for j in range(len(items)):
            own = words[first[j] : first[j + 1]]
            k = min(SHINGLE, len(own))
            f = shingles(own, k) if k else np.zeros(0, np.uint64)
            self.k.append(k)
            self.features.append(f)
            self.sets.append(np.unique(f, return_counts=True))
            if not len(f):
                continue
            sums = counters(f)
            full = max(w for w in LADDER if w <= len(f))
            half = max(w for w in LADDER if w <= max(1, len(f) // 2))
            places = {(full, 0), (full, (len(f) - full) // 2), (full, len(f) - full), (half, 0), (half, len(f) - half)}
            for w, at in sorted(places):
                windows.setdefault((k, w), []).append((j, at, int(fingerprints(sums[:, at : at + w + 1], w)[0])))
        self.groups = []
        width = 64 // BLOCKS
        for (k, w), entries in sorted(windows.items()):
            item = np.array([e[0] for e in entries], np.int32)
            at = np.array([e[1] for e in entries], np.int64)
            print_ = np.array([e[2] for e in entries], np.uint64)
            tables = []
            for b in range(BLOCKS):
                value, owner = [], []
                for n, e in enumerate(entries):
                    some = _variants(e[2] >> (width * b) & (1 << width) - 1, width)
                    value += some
                    owner += [n] * len(some)
                value, owner = np.array(value, np.int64), np.array(owner, np.int32)
                order = np.argsort(value, kind="stable")
                tables.append((np.searchsorted(value[order], np.arange((1 << width) + 1)).astype(np.int32), owner[order]))
            self.groups.append((k, w, item, at, print_, tables))

    def candidates(self, features: np.ndarray, sums: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, first and last feature) of windows within RADIUS."""
        width = np.uint64(64 // BLOCKS)
        mask = np.uint64((1 << 64 // BLOCKS) - 1)
        for size, w, item, at, print_, tables in self.groups:
            if size != k:
                continue
            found = fingerprints(sums, w)
            for b, (start, owner) in enumerate(tables):
                value = ((found >> (width * np.uint64(b))) & mask).astype(np.int64)
                many = start[value + 1] - start[value]
                hit = np.flatnonzero(many)
                if not len(hit):
                    continue
                many = many[hit]
                window = np.repeat(hit, many)
                entry = owner[np.arange(many.sum()) + np.repeat(start[value[hit]] - np.cumsum(many) + many, many)]
                near = np.bitwise_count(found[window] ^ print_[entry]) <= RADIUS
                yield item[entry[near]], window[near], window[near] + w - 1


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of features: sum of least counts over sum of greatest."""
    values, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(back[: len(a)], minlength=len(values))
    y = np.bincount(back[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum()) if len(values) else 0.0


def best_span(values: np.ndarray, counts: np.ndarray, text: np.ndarray, least: float) -> tuple[float, int, int] | None:
    """The greatest similarity of an item (different features in ascending order, their counts) to any span text[start:end], with the first such span; None if no span reaches least.

    A span gains by a further feature that the item has and the span has too
    few of, so the best one begins and ends where a run of them does.
    """
    size = int(counts.sum())
    slot = np.minimum(np.searchsorted(values, text), len(values) - 1)
    at = np.flatnonzero(values[slot] == text)
    if len(at) < least * size:
        return None
    slot = slot[at]
    n = len(at)
    # earlier: the occurrence of the same feature that must lie before the span for this one to count
    order = np.argsort(slot, kind="stable")
    back = np.arange(n) - counts[slot[order]]
    known = (back >= 0) & (slot[order[np.maximum(back, 0)]] == slot[order])
    earlier = np.full(n, -1)
    earlier[order[known]] = order[back[known]]
    many = np.bincount(slot, minlength=len(values))[slot] > counts[slot]
    apart = np.diff(at) > 1
    starts = np.flatnonzero(np.concatenate([[True], apart | many[:-1]]))
    ends = np.flatnonzero(np.concatenate([apart | many[1:], [True]]))
    best = None
    for chunk in np.array_split(starts, -(-len(starts) * n // 2_000_000)):
        counted = (np.arange(n) >= chunk[:, None]) & (earlier < chunk[:, None])
        shared = np.cumsum(counted, axis=1, dtype=np.int64)[:, ends]
        length = at[ends] - at[chunk][:, None] + 1
        s = np.where(length > 0, shared / np.maximum(size + length - shared, 1), 0.0)
        i, j = divmod(int(s.argmax()), len(ends))
        if s[i, j] >= least and (best is None or s[i, j] > best[0]):
            best = (float(s[i, j]), int(at[chunk[i]]), int(at[ends[j]]) + 1)
    return best


_RESULT = "doc_id long, item_id long, similarity double, first_word int, n_words int"


def find_leaks(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words of items (item_id, text) found in texts, at their best place each.

    Only texts that hold an item come out. Items of fewer than five words are
    one shingle of all their words; items and texts without words match
    nothing, nor do null texts. Null doc_ids come out as null. Repeated rows
    give repeated results; an item_id with several texts is matched by any.
    Empty tables give no rows. Other columns are ignored. Long texts are
    searched whole. One pass over the texts for BLOCK_ITEMS items; no shuffle.
    """
    out = None
    rows = items.where("text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    for index in _indexes(rows):
        part = _search(docs, index, least)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], _RESULT)
    return out


def _indexes(rows: DataFrame) -> Iterator[ItemIndex]:
    block: list = []
    for r in rows.toLocalIterator():
        block.append((r.item_id, r.text))
        if len(block) == BLOCK_ITEMS:
            yield ItemIndex(block)
            block = []
    if block:
        yield ItemIndex(block)


def _search(docs: DataFrame, index: ItemIndex, least: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        x = shared.value
        sizes = sorted({g[0] for g in x.groups})
        for batch in batches:
            rows = []
            ids = batch.column(0).cast(pa.int64())
            for a, _, data, offsets in string_blocks(batch.column(1)):
                words, first = letter_words(data, offsets)
                for k in sizes:
                    rows += _leaks(x, words, first, k, ids, a, least)
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return docs.where("text is not null").select("doc_id", "text").mapInArrow(run, _RESULT)


def _leaks(x: ItemIndex, words: np.ndarray, first: np.ndarray, k: int, ids: pa.Array, base: int, least: float) -> list[tuple]:
    features = shingles(words, k)
    sums = counters(features)
    found = [np.stack([item.astype(np.int64), p, q]) for item, p, q in x.candidates(features, sums, k)]
    if not found:
        return []
    places: dict[tuple[int, int], list[tuple[int, int]]] = {}
    hits = np.unique(np.concatenate(found, axis=1), axis=1)
    # a window over the edge of a text counts for the texts on both sides
    docs = np.searchsorted(first, hits[1:], "right") - 1
    for (item, p, q), a, b in zip(hits.T.tolist(), *docs.tolist(), strict=True):
        for doc in range(a, b + 1):
            places.setdefault((doc, item), []).append((p, q))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for (doc, item), windows in places.items():
        low, high = int(first[doc]), int(first[doc + 1]) - k + 1  # features within the document
        for a, b in _regions(windows, len(x.features[item]), least):
            a, b = max(a, low), min(b, high)
            if b <= a:
                continue
            span = best_span(*x.sets[item], features[a:b], least)
            key = (doc, item)
            if span and (key not in best or span[0] > best[key][0]):
                best[key] = (span[0], a + span[1] - low, span[2] - span[1] + k - 1)
                if span[0] == 1:
                    break
    by_id: dict[tuple[int, int], tuple[float, int, int]] = {}
    for (doc, item), v in best.items():
        key = (doc, x.ids[item])
        if key not in by_id or v[0] > by_id[key][0]:
            by_id[key] = v
    return [(ids[base + doc].as_py(), i, *v) for (doc, i), v in sorted(by_id.items(), key=lambda e: (e[0][0], e[0][1] is None, e[0][1] or 0))]


def _regions(windows: list[tuple[int, int]], size: int, least: float) -> Iterator[tuple[int, int]]:
    """Ranges of features that cover every span of similarity least or more around one of the windows, in ascending order; windows of an item's length share one."""
    reach = int(size / least)  # a longer span isn't similar enough
    group: list[tuple[int, int]] = []
    for window in [*sorted(windows), None]:
        if group and (window is None or window[0] - group[0][0] > size):
            yield min(q for _, q in group) + 1 - reach, group[-1][0] + reach
            group = []
        group.append(window)


def keep_clean(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, that hold no item; rows without a doc_id stay."""
    leaks = stage(find_leaks(docs, items, least).where("doc_id is not null").select("doc_id").distinct(), "leaks")
    return docs.join(checked_broadcast(leaks), "doc_id", "left_anti").select(*docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
SQL: dict[str, str] = {}
