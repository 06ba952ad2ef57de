import random
import re
import zlib
from collections import Counter

from loomwright.llm.spelling import SpellingParameters, _shifted, merge_postings, near_words, variants

import numpy as np

SCHEMA = "doc_id long, text string, word string, n int, root string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, p):
    counts = Counter()
    for d, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if p.damage and h % p.damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= p.least_length and n >= p.least_count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= p.ratio * n else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, words[w], len(near[w]), form[w], words.get(form[w]), root))
    return out


def made(seed, alphabet, rows, stems=30):
    rng = random.Random(seed)
    words = []
    for _ in range(stems):
        w = "".join(rng.choice(alphabet) for _ in range(rng.randrange(4, 10)))
        words += [w] * rng.choice([1, 5, 30])
        for _ in range(4):
            i, v = rng.randrange(len(w)), rng.choice(alphabet)
            words += [rng.choice([w[:i] + w[i + 1 :], w[:i] + v + w[i:], w[:i] + v + w[i + 1 :]])] * rng.choice([1, 1, 2])
    return [(i if i % 11 else None, rng.choice([" ", "-", "\n", "_9 ", "¬", "中"]).join(rng.choices(words, k=60)), "x", 1, "y") for i in range(rows)]


def check(spark, docs, p):
    got = variants(spark.createDataFrame(docs, SCHEMA).repartition(3), p)
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()} == brute(docs, p)


def test_variants_against_brute_force(spark):
    docs = made(1, "abÉßñ×A", 90) + [(9, None, "", 0, ""), (9, "", "", 0, ""), (3, "ab" * 40_000, "", 0, ""), (3, "abcdefg " * 300 + "abcdef " * 5, "", 0, "")]
    check(spark, docs + docs[:3], SpellingParameters(damage=7))


def test_crowded_buckets_are_dealt_anew(spark):
    # few letters and equal beginnings and ends: most words share both halves of their bucket's key
    rng = random.Random(5)
    words = {"stem" + "".join(rng.choice("ab") for _ in range(rng.randrange(2, 9))) for _ in range(150)} | {"".join(rng.choice("ab") for _ in range(6)) + "end" for _ in range(40)}
    rows = [(w, rng.randrange(5, 400)) for w in sorted(words)]
    df = spark.createDataFrame(rows, "word string, n long")
    want = {(a, x, b, y) for a, x in rows for b, y in rows if one_edit(a, b)}
    for most in (2, 5, 2048):
        found = [tuple(r) for r in near_words(df, SpellingParameters(bucket_rows=most)).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_chains_and_ties(spark):
    rows = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 700, "zaaaaa": 25, "qqqqqq": 9}
    docs = [(i, " ".join(w for w, n in rows.items() if n > i), "", 0, "") for i in range(700)]
    check(spark, docs, SpellingParameters(damage=None))
    assert variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_heap_merge_against_counts():
    rng = random.Random(2)
    for _ in range(300):
        lists = [sorted(rng.sample(range(12), rng.randrange(0, 9))) for _ in range(rng.randrange(1, 7))]
        need = rng.randrange(1, 5)
        places = [rng.randrange(0, len(x) + 1) for x in lists]
        seen = Counter(v for x, at in zip(lists, places, strict=True) for v in x[at:])
        assert merge_postings(list(zip(lists, places, strict=True)), need) == sorted(v for v, n in seen.items() if n >= need)


def test_checksums_of_joined_texts():
    before = np.array([zlib.crc32(x) for x in (b"", b"1:", b"-77:")], np.uint32)
    after = _shifted(before, 9)
    for n in range(10):
        word = b"abcdefghi"[:n]
        assert [int(x) ^ zlib.crc32(word) for x in after[n]] == [zlib.crc32(x + word) for x in (b"", b"1:", b"-77:")]
