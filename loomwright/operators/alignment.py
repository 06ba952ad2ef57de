"""Order-preserving assignment: two lists in order are matched without crossings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.operators.grouped import by_key

# What a left item without a partner costs, and what a pair is worth that no word confirms.
SKIP_COST = 0.01
UNCONFIRMED = 0.02
#: Decisions of one group that are held at once; larger groups are gone through again by halves.
CELLS = 4_000_000
_SKIP, _PAIR, _FREE = 0, 1, 2


def _next_row(before: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best values with one more left item, and the decisions that lead to them: skip before pair before leaving the right item free on a tie."""
    skipped = before - SKIP_COST
    paired = np.full(len(before), -np.inf)
    paired[1:] = before[:-1] + np.where(scores == 0, UNCONFIRMED, scores)
    chosen = np.maximum(skipped, paired)
    best = np.maximum.accumulate(chosen)
    how = np.where(paired > skipped, _PAIR, _SKIP).astype(np.uint8)
    how[1:][best[:-1] > chosen[1:]] = _FREE
    return best, how


def align(n: int, m: int, scores: Callable[[int], np.ndarray], cells: int = CELLS) -> np.ndarray:
    """For each of n left items its partner among m right ones, or -1; scores(i) are those of left item i with all right ones.

    The sum of scores is the greatest that pairs in order can have. Memory is
    in proportion to m and the logarithm of n beyond `cells` decisions: then
    the later half of the left items is traced first, from a row of values in
    the middle, and the earlier half up to the place it leads to.
    """
    partner = np.full(n, -1, np.int64)

    def trace(low: int, high: int, before: np.ndarray, j: int) -> int:
        """Traces left items high - 1 to low back from place j; the place it comes to. before: values ahead of item low, up to place j."""
        if high - low > 1 and (high - low) * (j + 1) > cells:
            middle = (low + high) // 2
            row = before
            for i in range(low, middle):
                row, _ = _next_row(row, scores(i)[:j])
            there = trace(middle, high, row, j)
            return trace(low, middle, before[: there + 1], there)
        how = []
        for i in range(low, high):
            before, chosen = _next_row(before, scores(i)[:j])
            how.append(chosen)
        for i in range(high - 1, low - 1, -1):
            row = how[i - low]
            while row[j] == _FREE:
                j -= 1
            if row[j] == _PAIR:
                j -= 1
                partner[i] = j
        return j

    if n:
        trace(0, n, np.zeros(m + 1), m)
    return partner


def word_scores(left: list[list[str]], right: list[list[str]]) -> Callable[[int], np.ndarray]:
    """Shared words as a share of the shorter of two sets of words, 0 if one is empty."""
    places: dict[str, list[int]] = {}
    for j, words in enumerate(right):
        for w in words:
            places.setdefault(w, []).append(j)
    size = np.array([len(x) for x in right], np.int64)

    def scores(i: int) -> np.ndarray:
        shared = np.zeros(len(right), np.int64)
        for w in left[i]:
            if w in places:
                shared[places[w]] += 1
        return np.where(size > 0, shared, 0) / np.maximum(np.minimum(size, len(left[i])), 1)

    return scores


def ordered_alignment(left: DataFrame, right: DataFrame, keys: list[str], order: str, words: str, cells: int = CELLS) -> DataFrame:
    """keys, order of a left item, `partner` (order of the right item, null without one), `score` (null without one; 0: no word confirms the pair).

    left and right have keys, an order and an array of different words; lists
    of one key are matched in order, with the greatest sum of scores. Null
    arrays have no words. Items of one order stand as their words sort. A key
    is worked out in one task, in memory that grows with its items, not with
    their pairs. Keys of one side only: no partner, no row.
    """
    kind = left.schema[order].dataType.simpleString()
    key_schema = ", ".join(f"`{k}` {left.schema[k].dataType.simpleString()}" for k in keys)
    part = lambda df, side: df.select(*keys, F.lit(side).alias("__side"), F.col(order).alias("__order"), F.coalesce(F.array_sort(F.array_distinct(words)), F.array().cast("array<string>")).alias("__words"))
    k = len(keys)

    def work(rows: list[tuple]) -> Iterator[tuple]:
        cut = sum(r[k] == 0 for r in rows)
        mine, others = rows[:cut], rows[cut:]
        scores = word_scores([r[k + 2] for r in mine], [r[k + 2] for r in others])
        for i, j in enumerate(align(len(mine), len(others), scores, cells).tolist()):
            found = (others[j][k + 1], float(scores(i)[j])) if j >= 0 else (None, None)
            yield (*mine[i][: k], mine[i][k + 1], *found)

    return by_key(part(left, 0).unionByName(part(right, 1)), keys, ["__side", "__order", "__words"], work, f"{key_schema}, `{order}` {kind}, partner {kind}, score double")
