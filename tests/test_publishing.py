"""Publications: what readers get after failures, refusals and roll-backs."""

import pytest
from pyspark.sql import functions as F

from loomwright.sources import publishing
from loomwright.sources.files import signature
from loomwright.sources.shared import new_path


def test_versions(spark):
    folder = new_path(spark, "publications")
    audits = {"lost": publishing.no_rows_lost("k"), "keys": publishing.unique_and_known("k")}
    table = lambda rows: spark.createDataFrame(rows, "k int, t string")
    out = lambda: sorted(tuple(r) for r in publishing.current(spark, folder).collect())
    assert publishing.current(spark, folder) is None and publishing.history(spark, folder).count() == 0
    with pytest.raises(ValueError):
        publishing.roll_back(spark, folder)
    one, two, three = [(1, "a"), (2, None)], [(1, "b"), (2, None), (3, "")], [(1, "c"), (2, "c"), (3, "c")]
    assert publishing.publish(table(one), folder, audits) == publishing.Publication("published", 1, {})
    sign = signature(publishing.current(spark, folder), ["k", "t"]).first()
    assert publishing.publish(table(one[::-1]), folder, audits) == publishing.Publication("unchanged", 1, {})
    assert publishing.publish(table([*one, (2, "x"), (None, "x")]), folder, audits) == publishing.Publication("refused", None, {"keys": 2})
    assert publishing.publish(table(one[:1]), folder, audits).violations == {"lost": 1} and out() == one
    assert publishing.publish(table(two), folder, audits).number == 2
    assert publishing.publish(table(three), folder, audits).number == 3
    # a job that fails in the middle changes nothing
    with pytest.raises(Exception):
        publishing.publish(table(three).withColumn("t", F.raise_error(F.lit("no"))), folder, audits)
    assert out() == three
    assert publishing.roll_back(spark, folder) == 4 and out() == two
    assert publishing.roll_back(spark, folder) == 5 and out() == one
    assert signature(publishing.current(spark, folder), ["k", "t"]).first() == sign
    with pytest.raises(ValueError):
        publishing.roll_back(spark, folder)
    assert publishing.publish(table(three), folder, audits).number == 6 and out() == three
    assert publishing.roll_back(spark, folder) == 7 and out() == one


def test_empty_table_and_clashing_columns(spark):
    folder = new_path(spark, "publications")
    df = spark.createDataFrame([(1, 2, "v", 3)], "k int, number int, version string, rows int")
    audits = {"lost": publishing.no_rows_lost("k")}
    assert publishing.publish(df.limit(0), folder, audits).outcome == "published"
    assert publishing.publish(df, folder, audits).outcome == "published"
    assert [tuple(r) for r in publishing.current(spark, folder).collect()] == [(1, 2, "v", 3)]


def test_inverse(spark):
    log = spark.createDataFrame([(1, 7, "a", "b"), (2, 7, "b", "")], "event int, k int, find string, put string")
    assert [tuple(r) for r in publishing.inverse(log).collect()] == [(-1, 7, "b", "a")]


def test_replay_stages_whole_texts_once(spark, monkeypatch):
    """They were written a second time, and joined again where nothing had moved."""
    from loomwright.operators import locating

    staged, plain = [], locating._staged
    monkeypatch.setattr(locating, "_staged", lambda df, what: staged.append(what) or plain(df, what))
    texts = spark.createDataFrame([(1, "a cat"), (2, "a dog")], "k long, t string")
    log = spark.createDataFrame([(1, 1, "cat", "hat"), (2, 3, "dog", "fog")], "event long, k long, find string, put string")
    out, _ = locating.replay_moved(texts, log, "k", "t")
    assert sorted(map(tuple, out.collect())) == [(1, "a hat"), (2, "a fog")] and staged.count("replayed") == 1
    out, _ = locating.replay_moved(texts, log.where("event = 1"), "k", "t")
    assert sorted(map(tuple, out.collect())) == [(1, "a hat"), (2, "a dog")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
