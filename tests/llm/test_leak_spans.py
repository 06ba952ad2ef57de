import random

import numpy as np

from loomwright.llm import decontaminate
from loomwright.llm.common import letter_words, shingles
from loomwright.llm.subwords import texts_block


def _features(text):
    return shingles(letter_words(*texts_block([text]))[0], decontaminate.SHINGLE)


def _brute(f, text):
    """The greatest similarity over all spans."""
    out = 0.0
    for a in range(len(text)):
        for b in range(a + 1, min(len(text), a + 2 * len(f)) + 1):
            out = max(out, decontaminate.similarity(f, text[a:b]))
    return out


def test_best_span_against_brute_force():
    rng = np.random.default_rng(1)
    for n in range(300):
        item = rng.integers(0, 2 + n % 9, int(rng.integers(1, 12))).astype(np.uint64)
        text = rng.integers(0, 3 + n % 9, int(rng.integers(1, 30))).astype(np.uint64)
        want = _brute(item, text)
        got = decontaminate.best_span(*np.unique(item, return_counts=True), text, 0.01)
        assert (got[0] if got else 0) == want
        assert not got or decontaminate.similarity(item, text[got[1] : got[2]]) == want


def test_insertions_and_deletions_in_the_middle(spark):
    random.seed(7)
    word = lambda: f"x{random.randrange(10**6)}"
    cases = [(104, 10, 0), (204, 20, 0), (204, 0, 20), (104, 0, 10), (59, 3, 0)]
    docs, items = [], []
    for n, (size, put, left) in enumerate(cases):
        item = [word() for _ in range(size)]
        half = size // 2
        edited = item[: half - left // 2] + [word() for _ in range(put)] + item[half + left - left // 2 :]
        items.append((n, " ".join(item)))
        docs.append((n, " ".join([word() for _ in range(30)] + edited + [word() for _ in range(40)])))
    # twice in one text, the second time whole; a window over the edge of a text
    docs.append((10, docs[0][1] + " " + items[0][1] + " tail"))
    docs.append((11, " ".join(items[1][1].split()[15:])))
    rows = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r for r in rows}
    assert set(got) == {(n, n) for n in range(len(cases))} | {(10, 0), (11, 1)}
    for n in range(len(cases)):
        assert got[n, n].similarity == _brute(_features(items[n][1]), _features(docs[n][1])) >= 0.8
        words = docs[n][1].split()[got[n, n].first_word :][: got[n, n].n_words]
        assert decontaminate.similarity(_features(items[n][1]), _features(" ".join(words))) == got[n, n].similarity
    assert got[10, 0].similarity == 1 and got[10, 0].n_words == 104
