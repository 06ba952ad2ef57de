"""Words and hashed character n-grams of text blocks, for models whose word score is linear in its n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.llm.common import codepoints, crc_mod3, folded_letters, mix, runs, span_hashes

_SYMBOL32 = mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_space = np.zeros(0x110000, bool)
_space[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_BASE = 0x9E3779B97F4A7C15


@dataclass
class Words:
    """Words of a block: runs of characters that are no white space, with a space put around each document.

    points: lower-cased code points; starts, ends: of the words in points;
    first: each document's first word (documents + 1 entries).
    """

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> int:
        return len(self.starts)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    points, at = codepoints(data, offsets)
    _, lower = folded_letters()
    points = np.insert(lower[points], at, 32)
    at = at + np.arange(len(at))
    starts, ends = runs(~_space[points], np.zeros(0, np.int64))
    return Words(points, starts, ends, np.searchsorted(starts, at))


def _extract(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Words:
    """Some words of a block as a block of their own."""
    size = ends - starts
    to = np.cumsum(size + 1) - size
    out = np.full(int((size + 1).sum()) + 1, 32, points.dtype)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + step] = points[np.repeat(starts, size) + step]
    return Words(out, to, to + size, np.array([0, len(starts)]))


def distinct(words: Words) -> tuple[Words, np.ndarray]:
    """The different words of a block, each once, and which of them each word is."""
    _, one, which = np.unique(span_hashes(words.points, words.starts, words.ends), return_index=True, return_inverse=True)
    return _extract(words.points, words.starts[one], words.ends[one]), which


def vocabulary(texts: list[str], step: int = 100) -> tuple[Words, np.ndarray, np.ndarray]:
    """The different words of all texts, which of them each word is, and each text's first word; `step` texts are held at a time."""
    blocks, hashes, words, first = [], [], [], [np.zeros(1, np.int64)]
    total = 0
    for a in range(0, len(texts), step):
        w = words_of(*texts_block(texts[a : a + step]))
        kinds, which = distinct(w)
        h = span_hashes(kinds.points, kinds.starts, kinds.ends)
        blocks.append(kinds)
        hashes.append(h)
        words.append(h[which])
        first.append(w.first[1:] + total)
        total += w.count
    shift = np.cumsum([0, *(len(x.points) for x in blocks)])[:-1]
    kinds_h, one = np.unique(np.concatenate(hashes), return_index=True)
    points = np.concatenate([x.points for x in blocks])
    starts = np.concatenate([x.starts + n for x, n in zip(blocks, shift, strict=True)])[one]
    ends = np.concatenate([x.ends + n for x, n in zip(blocks, shift, strict=True)])[one]
    return _extract(points, starts, ends), np.searchsorted(kinds_h, np.concatenate(words)), np.concatenate(first)


def grams(words: Words, sizes: tuple[int, ...], bits: int, whole: bool = True):
    """Yield (word of each n-gram, bucket of it) per size; an n-gram may reach one character over the word's ends."""
    n = len(words.points)
    inside = ~_space[words.points]
    filled = np.zeros(n + 1, np.int32)
    np.cumsum(inside, out=filled[1:])
    begins = np.zeros(n, np.int32)
    begins[words.starts] = 1
    word = np.cumsum(begins, dtype=np.int32) - 1
    symbols = _SYMBOL32[words.points]
    h = np.zeros(n, np.uint64)
    done = 0
    shift = np.uint64(64 - bits)
    for size in sorted(sizes):
        if n < size:
            break
        for k in range(done, size):
            h = h[: n - k] + symbols[k:] * np.uint64(pow(_BASE, k, 1 << 64))
        done = size
        m = n - size + 1
        if size == 1:
            use = np.flatnonzero(inside)
            yield word[use], _bucket(h[use], shift, size)
            continue
        inner = size - 2
        use = np.flatnonzero((filled[size - 1 : size - 1 + m] - filled[1 : 1 + m] == inner) if inner else inside[:m] | inside[1 : m + 1])
        # the word of the inner characters; for size 2 of whichever of the two is one
        if inner:
            yield word[use + 1], _bucket(h[use], shift, size)
        else:
            yield word[np.where(inside[use], use, use + 1)], _bucket(h[use], shift, size)
    if whole:
        yield np.arange(words.count, dtype=np.int32), _bucket(span_hashes(words.points, words.starts, words.ends), shift, 0)


def _bucket(h: np.ndarray, shift: np.uint64, size: int) -> np.ndarray:
    return ((h * np.uint64(0xD1342543DE82EF95 + 2 * size)) >> shift).astype(np.int32)


def texts_block(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def training_part(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & (crc_mod3(F.col("doc_id")) != 1))


def bounded_sample(marks: DataFrame, label: str, most: int, salts: int = 60) -> DataFrame:
    """doc_id, label: at most `most` ids of each label, spread by a hash of the id over salts with an equal bound each.

    No label's rows meet in one task.
    """
    salted = marks.select("doc_id", label, F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(salts)).alias("__salt"))
    order = Window.partitionBy(label, "__salt").orderBy(F.xxhash64("doc_id"), "doc_id")
    return salted.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= -(-most // salts)).select("doc_id", label)
