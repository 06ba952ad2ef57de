"""Quality classifier: hierarchical empirical Bayes over document, host and path.

A logistic model of surface features gives each text the odds of being good.
Grouped sums of those probabilities give hosts and paths a posterior mean:
a path is shrunk toward its host and a host toward the whole table, by as many
pseudo-documents as the spread of the group means (method of moments) calls
for. A document's own evidence is left out of its site's mean. Its score joins
the document's odds and its site's in log space.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import ascii_words, crc_mod3, drop_tables, spread_join, stage, string_blocks, table
from loomwright.llm.subwords import bounded_sample, texts_block, training_part


@dataclass(frozen=True)
class QualityParameters:
    """Training rows are bounded: per_label of each label. keep_from: least score of a document that is kept."""

    per_label: int = 3000
    #: Longer texts are no training rows (they are scored whole).
    train_chars: int = 50_000
    ridge: float = 1e-3
    site_weight: float = 0.5
    keep_from: float = 0.4


_CLASS = np.zeros(256, np.int64)  # 0 other signs
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[97:123] = 2
_CLASS[128:] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[33, 44, 46, 63, 39, 45, 58, 59, 34, 40, 41]] = 5
N_FEATURES = 10


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: shares of character classes, word length, repeated words, lines; all bounded, zeros for empty texts."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES))
    if not len(data):
        return out
    size = np.diff(offsets)
    some = np.maximum(size, 1)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * 6 + _CLASS[data], minlength=6 * n).reshape(n, 6)
    words, first = ascii_words(data, offsets)
    many = np.maximum(np.diff(first), 1)
    out[:, 0] = counts[:, 0] / many
    out[:, 1] = counts[:, 3] / np.maximum(counts[:, 2] + counts[:, 3], 1)
    out[:, 2] = counts[:, 4] / some
    out[:, 3] = counts[:, 5] / many
    out[:, 4] = (size - counts[:, 1]) / many / 10
    lines = np.bincount(doc[data == 10], minlength=n) + 1
    out[:, 5] = np.log1p(np.diff(first)) / 10
    out[:, 6] = lines / many
    bangs = (data == 33).astype(np.int64)
    out[:, 7] = np.bincount(doc, bangs, n) / many
    out[:, 8] = 1 - _distinct_share(words, first)
    out[:, 9] = (size > 0) & (np.diff(first) < 5)
    return np.minimum(out, 5.0)


def _distinct_share(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.ones(len(first) - 1)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a > 1:
            s = np.sort(words[a:b])
            out[i] = (1 + np.count_nonzero(s[1:] != s[:-1])) / (b - a)
    return out


def _expand(x: np.ndarray) -> np.ndarray:
    """Features, their square roots, and a constant."""
    return np.concatenate([x, np.sqrt(np.maximum(x, 0)), np.ones((len(x), 1))], axis=1)


class Evidence:
    """Logistic weights on standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray):
        self.mean, self.scale, self.weight = mean, scale, weight

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = (_expand(features(data, offsets)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weight, -30, 30)))


def train(texts: list[str], good: list[int], p: QualityParameters) -> Evidence:
    """Newton steps of ridge logistic regression. One label only, or none: its constant odds (none: even)."""
    y = np.array(good, float)
    d = 2 * N_FEATURES + 1
    if not len(y) or y.min() == y.max():
        w = np.zeros(d)
        w[-1] = 0 if not len(y) else (4 if y[0] else -4)
        return Evidence(np.zeros(d), np.ones(d), w)
    x = np.concatenate([_expand(features(*texts_block(texts[a : a + 500]))) for a in range(0, len(texts), 500)])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale[scale < 1e-9] = 0, 1
    scale[-1] = 1
    x = (x - mean) / scale
    w = np.zeros(d)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (q - y) / len(y) + p.ridge * w
        hessian = (x * (q * (1 - q))[:, None]).T @ x / len(y) + p.ridge * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Evidence(mean, scale, w)


def fit(docs: DataFrame, labels: DataFrame, p: QualityParameters) -> Evidence:
    """Learn from documents whose crc32 of the id modulo 3 isn't 1; a document with several labels is good only if all say so."""
    marks = training_part(labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")))
    ids = bounded_sample(marks, "quality", p.per_label)
    found = docs.where(F.col("text").isNotNull() & (F.length("text") <= p.train_chars)).select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).select("text", "quality").toPandas()
    return train(found["text"].tolist(), found["quality"].astype(int).tolist(), p)


def evidence(docs: DataFrame, model: Evidence, keep: tuple[str, ...], text_column: str = "text") -> DataFrame:
    """The kept columns and __p, the model's probability that the text is good. No shuffle; a kept text crosses to Python once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sent = keep if text_column in keep else (*keep, text_column)
    at = sent.index(text_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        for batch in batches:
            parts = [shared.value.probability(data, offsets) for _, _, data, offsets in string_blocks(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*keep, "__p"])

    return docs.select(*sent).mapInArrow(run, docs.select(*keep).schema.add("__p", "double"))


def _pseudo(groups: DataFrame, mean: str) -> Column:
    """Pseudo-documents by the method of moments: m (1 - m) / variance between groups - 1, within 1 and 1000."""
    row = groups.where("n >= 2").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(mean), 2)).alias("between"), F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("within")).first()
    if not row.n or not row.between:
        return F.lit(1000.0)
    return F.lit(float(min(1000.0, max(1.0, row.within / row.between - 1))))


def _keyed(docs: DataFrame, site_column: str) -> DataFrame:
    site = F.regexp_replace(F.coalesce(F.col(site_column).cast("string"), F.lit("")), "^[a-zA-Z]+://", "")
    return docs.withColumn("__host", F.substring_index(site, "/", 1)).withColumn("__path", F.substring_index(site, "/", 2))


def site_posteriors(rows: DataFrame) -> tuple[DataFrame, float]:
    """Sums and pseudo-documents of every path and its host from rows(__host, __path, __p), and the table's mean."""
    groups = stage(rows.groupBy("__host", "__path").agg(F.count(F.lit(1)).alias("n"), F.sum("__p").alias("s")), "paths")
    total = groups.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    prior = min(max(total.s / total.n, 1e-3), 1 - 1e-3) if total.n else 0.5
    paths = groups.where("__host <> ''")
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("m", F.lit(prior))
    a_host = _pseudo(hosts, "m")
    hosts = hosts.withColumn("host_mean", (F.col("s") + a_host * F.col("m")) / (F.col("n") + a_host)).select("__host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), "host_mean")
    paths = paths.join(hosts, "__host")
    a_path = _pseudo(paths, "host_mean")
    sites = paths.select("__path", F.col("n").alias("__n"), F.col("s").alias("__s"), F.col("host_n").alias("__host_n"), F.col("host_s").alias("__host_s")).withColumn("__a_host", a_host).withColumn("__a_path", a_path)
    return stage(sites, "sites"), prior


def _scored(rows: DataFrame, sites: DataFrame, prior: float, p: QualityParameters) -> DataFrame:
    """rows with __host_posterior, __path_posterior and __score; a document's own evidence is taken out of its site's sums."""
    x = spread_join(rows, sites, "__path")
    inside = lambda q: F.least(F.greatest(q, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = lambda q: F.log(q / (1 - q))
    host = (F.col("__host_s") - F.col("__p") + F.col("__a_host") * prior) / (F.col("__host_n") - 1 + F.col("__a_host"))
    path = (F.col("__s") - F.col("__p") + F.col("__a_path") * F.col("__host_posterior")) / (F.col("__n") - 1 + F.col("__a_path"))
    x = x.withColumn("__host_posterior", inside(F.coalesce(host, F.lit(prior)))).withColumn("__path_posterior", inside(F.coalesce(path, F.lit(prior))))
    total = odds(inside(F.col("__p"))) + p.site_weight * (odds(F.col("__path_posterior")) - float(np.log(prior / (1 - prior))))
    return x.withColumn("__score", 1 / (1 + F.exp(-total)))


def score_quality(docs: DataFrame, model: Evidence, p: QualityParameters | None = None, id_column: str = "doc_id", site_column: str = "source") -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score (0 to 1), keep (0 or 1) of every row.

    A site is host[/path]; its host is what stands before the first slash, its
    path host and first segment. Null or empty sites have the table's prior.
    Null or empty texts are judged by the model's features of an empty text.
    Repeated rows are documents each. An empty table gives no rows; other
    columns are ignored.
    """
    p = p or QualityParameters()
    keyed = _keyed(docs.select(F.col(id_column).alias("doc_id"), "text", F.col(site_column).alias("__site")), "__site")
    rows = stage(evidence(keyed, model, ("doc_id", "__host", "__path")), "evidence")
    sites, prior = site_posteriors(rows)
    x = _scored(rows, sites, prior, p)
    return x.select("doc_id", F.col("__p").alias("evidence"), F.col("__host_posterior").alias("host_posterior"), F.col("__path_posterior").alias("path_posterior"), F.col("__score").alias("score"), (F.col("__score") >= p.keep_from).cast("int").alias("keep"))


def keep_good(docs: DataFrame, model: Evidence, p: QualityParameters | None = None, site_column: str = "source") -> DataFrame:
    """The rows of docs, all columns, that score_quality would keep. Texts are scored twice and never shuffled.

    Null or empty texts are judged as score_quality does, rows without a site
    by the table's prior. Repeated rows and rows with null or repeated doc_ids
    are documents each. An empty table gives no rows; columns of any name pass.
    """
    p = p or QualityParameters()
    names = docs.columns
    own = tuple(f"c{i}" for i in range(len(names)))
    text = own[names.index("text")]
    keyed = _keyed(docs.toDF(*own), own[names.index(site_column)])
    sites, prior = site_posteriors(evidence(keyed, model, ("__host", "__path"), text))
    # beyond the bound of a broadcast only texts of rare sites are shuffled; those of frequent ones stay where they are
    scored = _scored(evidence(keyed, model, (*own, "__host", "__path"), text), sites, prior, p)
    return scored.where(F.col("__score") >= p.keep_from).select(*own).toDF(*names)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, p = table(spark, sf_dir, "documents"), QualityParameters()
    out = score_quality(docs, fit(docs, table(spark, sf_dir, "labels"), p), p)
    return out.withColumn("held_out", F.coalesce(crc_mod3(F.col("doc_id")) == 1, F.lit(False)))


QUERIES = {"op5_quality": op5_quality}
SQL: dict[str, str] = {}
