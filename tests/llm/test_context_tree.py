import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from functools import cache

import numpy as np
import pytest

from loomwright.llm.context_tree import ContextTreeParameters, log_kt, score_documents

SCHEMA = "doc_id long, text string, chunk int, learn string, score double"


def stream(text, depth):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return b"\n" * depth + b"".join(w + b" " for w in words) + b"\n", words


def brute(docs, depth):
    """The tree by its recursive definition, with exact fractions."""
    learned = [d[1] for d in docs if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 10]
    counts = Counter()
    for text in learned:
        s, _ = stream(text, depth)
        for i in range(depth, len(s)):
            for bit in range(8):
                for d in range(depth + 1):
                    counts[s[i - d : i], bit, s[i] >> (8 - bit), s[i] >> (7 - bit) & 1] += 1
    longer = {}
    for context, bit, prefix, _ in counts:
        if context:
            longer.setdefault((context[1:], bit, prefix), set()).add(context)

    def kt(zeros, ones):
        p, a, b = Fraction(1), 0, 0
        for _ in range(zeros):
            p, a = p * Fraction(2 * a + 1, 2 * (a + b + 1)), a + 1
        for _ in range(ones):
            p, b = p * Fraction(2 * b + 1, 2 * (a + b + 1)), b + 1
        return p

    @cache
    def own(context, bit, prefix):
        return kt(counts[context, bit, prefix, 0], counts[context, bit, prefix, 1])

    @cache
    def children(context, bit, prefix):
        return math.prod((weighted(c, bit, prefix) for c in longer.get((context, bit, prefix), ())), start=Fraction(1))

    @cache
    def weighted(context, bit, prefix):
        if len(context) == depth:
            return own(context, bit, prefix)
        return (own(context, bit, prefix) + children(context, bit, prefix)) / 2

    @cache
    def one(history, d, bit, prefix):
        context = history[len(history) - d :]
        zeros, ones = counts[context, bit, prefix, 0], counts[context, bit, prefix, 1]
        p = Fraction(2 * ones + 1, 2 * (zeros + ones + 1))
        if d == depth:
            return p
        share = own(context, bit, prefix) / (own(context, bit, prefix) + children(context, bit, prefix))
        return share * p + (1 - share) * one(history, d + 1, bit, prefix)

    tokens = Counter()
    for text in learned:
        tokens.update(stream(text, depth)[1])
        tokens[None] += 1
    n, v = sum(tokens.values()), len(tokens)
    out = []
    for doc_id, text, *_ in docs:
        s, words = stream(text, depth)
        log = 0.0
        for i in range(depth, len(s)):
            for bit in range(8):
                p = one(s[i - depth : i], 0, bit, s[i] >> (8 - bit))
                log += math.log10(p if s[i] >> (7 - bit) & 1 else 1 - p)
        base = sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words, None])
        out.append((doc_id, doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0, len(words) + 1, sum(tokens[w] > 0 for w in [*words, None]), n, base, log, len(s) - depth))
    return out


def rows_of(df):
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.n_bytes) for r in df.collect()]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[7], round(r[6], 5))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] + r[7:] for r in got] == [r[:5] + r[7:] for r in want]
    assert np.allclose([r[5:7] for r in got], [r[5:7] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize(("depth", "block_rows"), [(0, 1000), (1, 40), (2, 25), (3, 60)])
def test_scores_against_the_definition(spark, depth, block_rows):
    rng = random.Random(depth)
    words = ["the", "THE", "ab", "abc", "É", "中", "a b", "zz"]
    docs = [(i, rng.choice([" ", "\n", "\t \x0b"]).join(rng.choices(words, k=rng.randrange(0, 7))), 0, "", 0.0) for i in range(30)]
    docs += [(None, "ab the", 0, "", 0.0), (31, None, 0, "", 0.0), (32, "", 0, "", 0.0), docs[3], docs[3]]
    got = score_documents(spark.createDataFrame(docs, SCHEMA).repartition(3), ContextTreeParameters(depth=depth, chunk_bytes=100, block_rows=block_rows))
    same(rows_of(got), brute(docs, depth))


def test_blocks_and_chunks_change_nothing(spark):
    rng = random.Random(9)
    docs = [(i, " ".join("".join(rng.choices("abcde", k=rng.randrange(1, 6))) for _ in range(rng.choice([3, 40, 4000 if i == 5 else 9]))), 0, "", 0.0) for i in range(60)]
    df = spark.createDataFrame(docs, SCHEMA)
    same(rows_of(score_documents(df, ContextTreeParameters(chunk_bytes=500, block_rows=300))), rows_of(score_documents(df)))


def test_nothing_to_learn_from(spark):
    assert score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = score_documents(spark.createDataFrame([(held, "ab", 0, "", 0.0)], SCHEMA)).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.n_bytes) == (True, 2, 0, 0, 4)
    assert abs(r.base_score) < 1e-12 and abs(r.score - 32 * math.log10(0.5)) < 1e-9 and abs(r.bits_per_byte - 8) < 1e-9


def test_kt_of_large_counts():
    a, b = np.array([3, 5000, 10**7]), np.array([4, 0, 3 * 10**6])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.lgamma(x + y + 1) - math.log(math.pi) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert np.allclose(log_kt(a, b), want, rtol=1e-12)


def test_codes_unseen_documents_better_than_single_tokens(spark):
    got = score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").groupBy().sum("score", "base_score", "n_bytes").first()
    assert got[0] > got[1] and -got[0] * math.log2(10) / got[2] < 2.7
