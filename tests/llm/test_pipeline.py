import base64
import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline as cp
from loomwright.llm import decontaminate, jaccard, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    got = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    p = quality.QualityParameters()
    good = {r.doc_id for r in quality.score_quality(docs, quality.fit(docs, labels, p), p).where("keep = 1").collect()}
    left = docs.where(docs.doc_id.isin(list(good))).cache()
    model = toxicity.fit(left, labels, toxicity.ToxicityParameters())
    civil = {r.doc_id for r in toxicity.score_documents(left, model).where("__score < 0.7").collect()}
    left = left.where(left.doc_id.isin(list(civil))).cache()
    one = {r.doc_id for r in jaccard.jaccard_groups(left).where("doc_id = component_id").collect()}
    leaked = {r.doc_id for r in decontaminate.find_leaks(left, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(got) == one - leaked
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in left.collect():
        if r.doc_id in got:
            assert list(got[r.doc_id].ids) == library.encode_ordinary(r.text)
            assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, step in cp.STAGES[:-1]:
        assert step(spark, docs.limit(30), SF).columns == docs.columns


def test_odd_tables(spark, tmp_path):
    """Null, empty and repeated rows, clashing columns, and empty tables through all stages."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, __host string, __p double, item_id long, score double"
    calm = "a calm text about rivers and hills that nobody would call rude at all number "
    rows = [(i, f"{calm}{i} {i * 7} {i * 13} and so on for a while", "en", "s", 1, "h", 0.5, 3, 1.0) for i in range(30)]
    rows += [(None, None, None, None, None, None, None, None, None), (40, None, "en", "s", 0, "h", 0.1, 1, 1.0), (41, "", "en", "s", 0, "h", 0.1, 1, 1.0), rows[0], rows[1]]
    labels = [(i, 1, 0) for i in range(30)]
    for name, data, schema in (("documents", rows, columns), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, "words that no document here holds in this order at all")], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/odd/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    got = cp.run(spark, f"{tmp_path}/odd").collect()
    ids = [r.doc_id for r in got]
    assert len(ids) == len(set(ids)) and set(range(30)) <= set(ids)
    assert all(r.n_tokens == len(r.ids) for r in got) and all(r.n_tokens == 0 for r in got if r.doc_id in (40, 41, None))
    assert cp.run(spark, f"{tmp_path}/empty").count() == 0
