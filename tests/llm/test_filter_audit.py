import itertools
import random
import re

import numpy as np

from loomwright.llm.filter_audit import STATS, audit_documents, plain_changes, walk

SCHEMA = "doc_id long, text string, lang string, source string, part string, mask int"
MARKS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    good = {d for d, q, t in labels if d is not None and q == 1}
    toxic = {d for d, q, t in labels if d is not None and t == 1}
    rows = []
    for d, text, _, source, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": d is not None and any(x is not None and x < d and (y or "") == text for x, y, *_ in docs),
        }
        rows.append((source or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for i, f in enumerate(order):
                left = [r for r in own if not r[1] & set(order[:i])]
                gone = [r for r in left if f in r[1]]
                total[f] += len(gone)
                redundant = sum(f in r[1] and bool(r[1] & set(order[:i])) for r in own)
                out[part, "".join(order), i + 1] = [len(left) - len(gone), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for order in itertools.permutations("ABCDE"):
            for i, f in enumerate(order):
                out[part, "".join(order), i + 1].append(total[f])
    return out


def result(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in STATS] for r in df.collect()}


def test_plain_changes_visit_every_order():
    for k in range(1, 7):
        order, seen = list(range(k)), {tuple(range(k))}
        for i in plain_changes(k):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(k))))
        assert sum(1 for _ in plain_changes(k)) == len(seen) - 1


def test_walk_against_sums_of_cells():
    cells = np.random.default_rng(1).integers(0, 9, (3, 32, 3))
    names, stats = walk(cells, "ABCDE")
    assert len(names) == 120
    # what is kept in the end is what fails nothing, and all removals of an order add up
    assert (stats[:, :, 4, 0] == cells[None, :, 0, 0]).all()
    assert (stats[..., 1].sum(2) == cells[:, 1:, 0].sum(1)).all()


def test_audit_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a#b", "One Two " * 150, "x" * 50_000, " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(250)) + " $", "ÀÉ á b c", "a\x0bb\x0cc\rd " * 60]
    docs = [(i if rng.random() < 0.9 else None, rng.choice(texts), "en", rng.choice(["s", "t", "", None]), "clash", 7) for i in range(120)]
    docs += [docs[0], docs[1], (5, "again", "en", "s", "clash", 1), (5, "again", "en", "t", "clash", 1), (6, "again", "en", "t", "clash", 1)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 110, 2)] + [(2, 1, 1), (None, 1, 1)]
    got = result(audit_documents(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame(labels, MARKS)))
    assert got == brute(docs, labels)


def test_no_rows_and_no_labels(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], MARKS)
    assert audit_documents(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "abc", None, None, None, 1)], SCHEMA)
    got = result(audit_documents(one, labels))
    assert len(got) == 600 and got["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]
