import random

import numpy as np
import pytest

from loomwright.llm import decontaminate, language, quality, toxicity
from loomwright.llm.subwords import texts_block

SF = "/root/testdata/sf0.01"


def test_leaks(spark):
    random.seed(2)
    item = [f"word{i}" for i in range(50)]
    noise = lambda n: [f"x{random.randrange(10**6)}" for _ in range(n)]
    edited = list(item)
    edited[25] = "other"
    half = item[:25] + noise(25)
    rows = [(1, " ".join(noise(500) + item + noise(300)), "x"), (2, " ".join(noise(40) + edited + noise(9)).upper(), "x"), (3, " ".join(noise(20) + half), "x"), (4, None, "x"), (5, "", "x"), (6, " ".join(item), "x"), (7, " ".join(noise(3000)), "x"), (8, "say hi there", "x"), (None, " ".join(item), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, " ".join(item)), (11, "hi there"), (12, ""), (13, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(docs, items).collect()}
    assert set(got) == {(1, 10), (2, 10), (6, 10), (8, 11), (None, 10)}
    assert got[(1, 10)] == 1 and 0.8 <= got[(2, 10)] < 0.9
    assert sorted(r.doc_id or 0 for r in decontaminate.keep_clean(docs, items).collect()) == [0, 3, 4, 5, 7]
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), items).count() == 0


def test_fingerprint_by_definition():
    rng = np.random.default_rng(3)
    f = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    for w in (1, 2, 7, 30):
        got = decontaminate.fingerprints(decontaminate.counters(f), w)
        for i in range(len(f) - w + 1):
            want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in f[i : i + w]) > w)
            assert int(got[i]) == want


def test_index_finds_all_within_radius():
    index = decontaminate.ItemIndex([(1, " ".join(f"w{i}" for i in range(30)))])
    _, w, _, at, print_, tables = index.groups[0]
    random.seed(4)
    for _ in range(300):
        bits = random.sample(range(64), decontaminate.RADIUS)
        other = int(print_[0]) ^ sum(1 << b for b in bits)
        assert any(len(owner[start[v] : start[v + 1]]) for b, (start, owner) in enumerate(tables) for v in [other >> 16 * b & 65535])


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(5)
    sizes = [0, 1, 5, 7, 3, 7]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(0, 2, (first[-1], 3)).astype(np.float32)
    labels = language.viterbi(scores, first, 1.5)
    import itertools

    for a, b in zip(first[:-1], first[1:]):
        value = lambda path: sum(scores[a + i, s] for i, s in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:]))
        best = max(map(value, itertools.product(range(3), repeat=b - a)))
        assert abs(value(labels[a:b].tolist()) - best) < 1e-4


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, language.LanguageParameters())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !!"), (4, "the and of was " * 3000), (None, "der die und ist nicht")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(odd, model, spans=True).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred == "en" and got[None].lang_pred == "de"
    assert [s.n_words for s in got[4].spans] == [12000]
    seen = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1")
    assert seen.where("lang = lang_pred").count() >= 0.98 * seen.count()
    assert language.identify(odd, language.train([], [], language.LanguageParameters())).where("lang_pred = 'und'").count() == 5
    assert language.identify(odd.limit(0), model).count() == 0


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, quality.QualityParameters())
    seen = quality.score_quality(docs, model).join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1")
    assert seen.where("keep = quality").count() >= 0.97 * seen.count()
    odd = spark.createDataFrame([(1, None, None, "a"), (None, "", "", "b"), (3, "Some words.", "http://h.org/p/q", "c"), (3, "Some words.", "http://h.org/p/q", "c")], "doc_id long, text string, source string, score string")
    got = quality.score_quality(odd, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(odd.limit(0), model).count() == 0
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in quality.score_quality(docs, model).where("keep = 1").collect()}


def test_sparse_sites_shrink(spark):
    rows = [(i, "h/a", 0.9) for i in range(50)] + [(i, "h/b", 0.9) for i in range(50, 52)] + [(i, "k/c", 0.1) for i in range(60, 160)]
    x = spark.createDataFrame(rows, "doc_id long, source string, __p double")
    sites, prior = quality.site_posteriors(quality._keyed(x, "source"))
    got = {r.doc_id: r for r in quality._scored(quality._keyed(x, "source"), sites, prior, quality.QualityParameters()).collect()}
    assert abs(prior - np.mean([r[2] for r in rows])) < 1e-9
    assert got[0]["__path_posterior"] > 0.7 > 0.3 > got[100]["__path_posterior"]
    assert prior < got[50]["__path_posterior"] <= got[0]["__path_posterior"]


def test_toxicity_unseen_misspellings(spark):
    random.seed(6)
    words = [f"{a}{b}" for a in ("lor", "mip", "sun", "dol", "ame", "tri") for b in ("em", "sum", "or", "et", "ina", "ope")]
    make = lambda bad: " ".join(random.choice(words) for _ in range(20)) + (" " + random.choice(["worthless", "disgusting", "stupidity"]) + " " if bad else " ") + " ".join(random.choice(words) for _ in range(15))
    labels = [i % 2 for i in range(400)]
    model = toxicity.train([make(y) for y in labels], labels, toxicity.ToxicityParameters())
    score = lambda t: model.score(*texts_block([t]))[0]
    assert score("lorem misum worthlesss amina doletem") > 0.7 and score("disgustingg lorem") > 0.7
    assert score(make(0)) < 0.3 and score("") == 0 and 0 <= score("q") <= 1
    long = " ".join(make(0) for _ in range(300))
    assert score(long) < 0.5 < score(long + " worthless disgusting " + long)
    docs = spark.createDataFrame([(1, None, "s"), (2, "disgusting worthless", "t"), (None, "", "u")], "doc_id long, text string, score string")
    assert [r.score for r in toxicity.keep_civil(docs, model).orderBy("score").collect()] == ["s", "u"]
    assert toxicity.train([], [], toxicity.ToxicityParameters()).score(*texts_block(["x y"]))[0] < 0.01


@pytest.mark.parametrize("one", [0, 1])
def test_one_label(one):
    assert (toxicity.train(["a b"], [one], toxicity.ToxicityParameters()).score(*texts_block(["a b"]))[0] > 0.5) == bool(one)


def test_many_languages():
    """More labels than a byte holds come out as themselves."""
    rng = np.random.default_rng(9)
    scores = rng.normal(0, 1, (400, 300)).astype(np.float32)
    best = rng.integers(0, 300, 400)
    scores[np.arange(400), best] += 50
    assert language.viterbi(scores, np.array([0, 100, 100, 400]), 1.0).tolist() == best.tolist()
    names = [f"l{i:03d}" for i in range(150)]
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}qzj{i:03d}"[:5] * 2 for i in range(150)]
    model = language.train([f"{w} {w} {w}" for w in words], names, language.LanguageParameters())
    w, labels, _ = model.label(*texts_block([f"{words[140]} {words[140]}", words[3]]))
    assert [model.names[i] for i in labels] == ["l140", "l140", "l003"]


def test_posteriors_against_numpy(spark):
    """Host and path posteriors worked out once more with plain loops, each document's own evidence left out."""
    rng = random.Random(3)
    rows = [(i, f"h{rng.randrange(4)}/p{rng.randrange(5)}/x" if rng.random() < 0.9 else None, rng.random() ** 2) for i in range(400)]
    p = quality.QualityParameters()
    keyed = quality._keyed(spark.createDataFrame(rows, "doc_id long, source string, __p double"), "source")
    sites, prior = quality.site_posteriors(keyed)
    got = {r.doc_id: r for r in quality._scored(keyed, sites, prior, p).collect()}
    mean = sum(r[2] for r in rows) / len(rows)
    hosts, paths = {}, {}
    for _, site, e in rows:
        if site:
            hosts.setdefault(site.split("/")[0], []).append(e)
            paths.setdefault("/".join(site.split("/")[:2]), []).append(e)

    def pseudo(groups, of):
        some = {k: v for k, v in groups.items() if len(v) >= 2}
        within = sum(len(v) * of(k) * (1 - of(k)) for k, v in some.items())
        between = sum(len(v) * (sum(v) / len(v) - of(k)) ** 2 for k, v in some.items())
        return min(1000.0, max(1.0, within / between - 1))

    a = pseudo(hosts, lambda k: mean)
    host_mean = {k: (sum(v) + a * mean) / (len(v) + a) for k, v in hosts.items()}
    b = pseudo(paths, lambda k: host_mean[k.split("/")[0]])
    for i, site, e in rows:
        host = path = mean
        if site:
            h, q = hosts[site.split("/")[0]], paths["/".join(site.split("/")[:2])]
            host = (sum(h) - e + a * mean) / (len(h) - 1 + a)
            path = (sum(q) - e + b * host) / (len(q) - 1 + b)
        assert abs(got[i]["__host_posterior"] - host) < 1e-9 and abs(got[i]["__path_posterior"] - path) < 1e-9
        odds = lambda x: np.log(x / (1 - x))
        inside = min(max(e, 1e-6), 1 - 1e-6)
        assert abs(got[i]["__score"] - 1 / (1 + np.exp(-(odds(inside) + p.site_weight * (odds(path) - odds(mean)))))) < 1e-9


def test_stages_odd_rows(spark):
    """Nulls, repeated rows, clashing columns and empty tables in the stages that keep documents whole."""
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    columns = "doc_id long, text string, lang string, source string, __host string, __p double, score double, held_out string, predicted string, item_id long, c0 string"
    rows = [(i, ("nasty worthless words " if i % 2 else "calm and pleasant words ") * 5, "en", "h/p", "a", 0.5, 1.0, "b", "c", 3, "d") for i in range(60)]
    rows += [(None, None, None, None, None, None, None, None, None, None, None), (70, "", "", "", "", 0.0, 0.0, "", "", 0, "")] + rows[:2]
    docs = spark.createDataFrame(rows, columns)
    good = quality.keep_good(docs, quality.train([], [], quality.QualityParameters()))
    assert good.columns == docs.columns and sorted(map(str, good.collect())) == sorted(map(str, docs.collect()))
    model = toxicity.fit(docs, labels, toxicity.ToxicityParameters())
    civil = toxicity.keep_civil(docs, model)
    assert civil.columns == docs.columns
    assert {r.doc_id for r in civil.collect()} == {None, 70} | set(range(0, 60, 2)) and civil.where("doc_id = 0").count() == 2
    found = toxicity.predict(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.where("doc_id = 1").count() == 2
    for step in (quality.keep_good, toxicity.keep_civil):
        assert step(docs.limit(0), quality.train([], [], quality.QualityParameters()) if step is quality.keep_good else model).count() == 0
    assert toxicity.predict(docs, labels.limit(0)).where("predicted = 1").count() == 0
