"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word's vector is the average over its hashed character n-grams and itself, so
a misspelling that training never saw shares most of a known word's n-grams. A
passage of some words is the average of its words' vectors; its class
probabilities are a linear softmax of that. A document is as toxic as its three
most toxic passages on average, whatever its length: one word that may be
harmless doesn't decide. Training goes through the passages by an attention
that sharpens from the mean of all passages to the strongest ones, and each
batch loses a random share of its n-grams, as a misspelling would.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import crc_mod3, drop_tables, string_blocks, table
from loomwright.llm.subwords import bounded_sample, distinct, grams, training_part, vocabulary, words_of

#: A text is dealt out into passages of so many words, up to twice as many.
PASSAGE = 3
#: So many of a document's passages decide, or all it has.
STRONGEST = 3


@dataclass(frozen=True)
class ToxicityParameters:
    """Training rows are bounded: so many of each label, of texts up to train_chars."""

    per_label: int = 1500
    train_chars: int = 20_000
    sizes: tuple[int, ...] = (3, 4, 5)
    bits: int = 18
    width: int = 8
    epochs: int = 12
    least_steps: int = 800
    batch: int = 48
    rate: float = 1.0
    least_documents: int = 4
    least_kept: float = 0.2
    seed: int = 7


def _passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passage of each word, words of each passage, document of each passage, and passages of each document; first: first word of each document, and the end."""
    n = np.diff(first)
    many = np.where(n > 0, np.maximum(n // PASSAGE, 1), 0)
    start = np.cumsum(many) - many
    doc = np.repeat(np.arange(len(n)), n)
    passage = start[doc] + (np.arange(first[-1] - first[0]) - (first[doc] - first[0])) * many[doc] // n[doc]
    return passage, np.bincount(passage, minlength=int(many.sum())), np.repeat(np.arange(len(n)), many), many


def _ranks(z: np.ndarray, doc: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each passage in its document, the strongest 0, and the least value that is among a document's strongest."""
    order = np.lexsort((-z, doc))
    start = np.cumsum(many) - many
    rank = np.empty(len(z), np.int64)
    rank[order] = np.arange(len(z)) - start[doc[order]]
    least = np.zeros(len(many))
    full = many > 0
    least[full] = z[order][(start + np.minimum(many, STRONGEST) - 1)[full]]
    return rank, least


class Folded:
    """A trained model folded to what scoring needs: since all is linear up to the softmax, one number per n-gram bucket."""

    def __init__(self, bucket: np.ndarray, bias: float, p: ToxicityParameters):
        self.bucket, self.bias, self.p = bucket.astype(np.float32), bias, p

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        w = words_of(data, offsets)
        out = np.zeros(len(offsets) - 1)
        if not w.count:
            return out
        kinds, which = distinct(w)
        total, count = np.zeros(kinds.count), np.zeros(kinds.count)
        for word, bucket in grams(kinds, self.p.sizes, self.p.bits):
            total += np.bincount(word, self.bucket[bucket], kinds.count)
            count += np.bincount(word, minlength=kinds.count)
        score = (total / np.maximum(count, 1))[which]
        passage, size, doc, many = _passages(w.first)
        z = np.bincount(passage, score, len(size)) / size
        top = _ranks(z, doc, many)[0] < STRONGEST
        full = many > 0
        z = np.bincount(doc[top], z[top], len(many))[full] / np.minimum(many, STRONGEST)[full]
        out[full] = 1 / (1 + np.exp(-np.clip(z + self.bias, -60, 60)))
        return out


def train(texts: list[str], labels: list[int], p: ToxicityParameters) -> Folded:
    """Joint training of embeddings and softmax. Without both labels: a model that scores the one label there is (else 0)."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Folded(np.zeros(1 << p.bits), 30.0 if len(y) and y[0] else -30.0, p)
    rng = np.random.default_rng(p.seed)
    order = sorted(range(len(texts)), key=lambda i: texts[i])
    texts, y = [texts[i] for i in order], y[order]
    kinds, kind, first_word = vocabulary(texts)
    parts = list(grams(kinds, p.sizes, p.bits))
    gram_word = np.concatenate([a for a, _ in parts])
    gram_bucket = np.concatenate([b for _, b in parts])
    by_word = np.argsort(gram_word, kind="stable")
    gram_bucket, gram_word = gram_bucket[by_word], gram_word[by_word]
    at = np.searchsorted(gram_word, np.arange(kinds.count + 1))
    del parts
    # what few documents hold can only be learned by heart: it keeps its place in the average, at zero
    documents = _document_counts(kind, first_word, at, gram_bucket, 1 << p.bits)
    known = documents[gram_bucket] >= min(p.least_documents, 1 + len(y) // 100)
    total = np.maximum(np.diff(at), 1)
    gram_bucket, gram_word = gram_bucket[known], gram_word[known]
    at = np.searchsorted(gram_word, np.arange(kinds.count + 1))
    used, gram_bucket = np.unique(gram_bucket, return_inverse=True)
    e = rng.normal(0, 0.05, (len(used), p.width))
    u = rng.normal(0, 1.0, (2, p.width))
    b = np.array([0.0, 0.0])
    ge, gu, gb = np.full(len(used), 1e-3), np.full((2, p.width), 1e-3), np.full(2, 1e-3)
    positive = y.mean()
    # few rows: more epochs, so that the steps suffice
    batches = max(1, len(y) // p.batch)
    epochs = max(p.epochs, -(-p.least_steps // batches))
    for epoch in range(epochs):
        sharp = min(30.0, 0.25 * 2.0 ** (12 * epoch / epochs))
        for some in np.array_split(rng.permutation(len(y)), batches):
            counts = np.diff(first_word)[some]
            if not counts.sum():
                continue
            tokens = np.concatenate([np.arange(first_word[d], first_word[d + 1]) for d in some])
            first = np.concatenate([[0], np.cumsum(counts)])
            words, back = np.unique(kind[tokens], return_inverse=True)
            lengths = at[words + 1] - at[words]
            g_word = np.repeat(np.arange(len(words)), lengths)
            g = gram_bucket[np.arange(lengths.sum()) + np.repeat(at[words] - np.cumsum(lengths) + lengths, lengths)]
            keep = rng.random(len(g)) < rng.uniform(p.least_kept, 1)
            g, g_word = g[keep], g_word[keep]
            vectors = np.zeros((len(words), p.width))
            for k in range(p.width):
                vectors[:, k] = np.bincount(g_word, e[g, k], len(words))
            lengths = total[words]
            vectors /= lengths[:, None]
            logits = vectors @ u.T
            margin = (logits[:, 1] - logits[:, 0])[back]
            passage, size, doc, many = _passages(first)
            z = np.bincount(passage, margin, len(size)) / size
            least = _ranks(z, doc, many)[1]
            # the strongest passages count alike, weaker ones less and less
            a = np.exp(np.clip(sharp * (z - least[doc]), -700, 0))
            a /= np.bincount(doc, a, len(some))[doc]
            pooled = np.bincount(doc, a * z, len(some)) + b[1] - b[0]
            probability = 1 / (1 + np.exp(-np.clip(pooled, -60, 60)))
            weight = np.where(y[some] == 1, 0.5 / positive, 0.5 / (1 - positive)) ** 0.5
            grad = np.where(many > 0, weight * (probability - y[some]), 0) / len(some)
            d_word = (a * grad[doc] / size)[passage]
            d_margin = np.bincount(back, d_word, len(words))
            direction = u[1] - u[0]
            d_u = d_margin @ vectors
            d_gram = (d_margin / lengths)[g_word]
            d_e = np.bincount(g, d_gram, len(used))
            touched = np.flatnonzero(d_e)
            # one Adagrad step per bucket and per softmax weight
            ge[touched] += d_e[touched] ** 2 * (direction @ direction)
            e[touched] -= p.rate * (d_e[touched] / np.sqrt(ge[touched]))[:, None] * direction
            for c, sign in ((0, -1), (1, 1)):
                gu[c] += d_u**2
                u[c] -= p.rate * sign * d_u / np.sqrt(gu[c])
                gb[c] += grad.sum() ** 2
                b[c] -= 0.2 * p.rate * sign * grad.sum() / np.sqrt(gb[c])
    bucket = np.zeros(1 << p.bits)
    bucket[used] = e @ (u[1] - u[0])
    return Folded(bucket, float(b[1] - b[0]), p)


def _document_counts(kind: np.ndarray, first: np.ndarray, at: np.ndarray, gram_bucket: np.ndarray, size: int) -> np.ndarray:
    """In how many documents each bucket occurs."""
    out = np.zeros(size, np.int32)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        words = np.unique(kind[a:b])
        lengths = at[words + 1] - at[words]
        out[np.unique(gram_bucket[np.arange(lengths.sum()) + np.repeat(at[words] - np.cumsum(lengths) + lengths, lengths)])] += 1
    return out


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityParameters) -> Folded:
    """Learn from documents whose crc32 of the id modulo 3 isn't 1. A document with several labels is toxic if any says so.

    The bounded sample is drawn from labels of documents that there are and that are short enough to learn from.
    """
    usable = docs.where(F.col("text").isNotNull() & (F.length("text") <= p.train_chars))
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = bounded_sample(training_part(marks).join(usable.select("doc_id"), "doc_id", "left_semi"), "toxic", p.per_label)
    found = usable.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic").toPandas()
    return train(found["text"].tolist(), found["toxic"].astype(int).tolist(), p)


def score_documents(docs: DataFrame, model: Folded, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text", below: float | None = None) -> DataFrame:
    """The kept columns of docs with __score (0 to 1): the probability that the strongest passage is toxic; with `below` only rows that score less.

    Null, empty or blank text: 0. Every word of a long text counts. Repeated
    rows score alike; names of other columns don't matter. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sent = keep if text_column in keep else (*keep, text_column)
    at = sent.index(text_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        m = shared.value
        for batch in batches:
            parts = [m.score(data, offsets) for _, _, data, offsets in string_blocks(batch.column(at))]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores)], names=[*keep, "__score"])
            yield out if below is None else out.filter(pa.array(scores < below))

    return docs.select(*sent).mapInArrow(run, docs.select(*keep).schema.add("__score", "double"))


def predict(docs: DataFrame, labels: DataFrame, p: ToxicityParameters | None = None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every row, by a model of the rows that aren't held out.

    Null doc_ids are not held out and not learned from. Null or empty texts
    score 0, repeated rows alike. No labels: no document is toxic. An empty
    table gives no rows; other columns, whatever their names, are ignored.
    """
    rows = docs.select("doc_id", "text")
    scored = score_documents(rows, fit(rows, labels, p or ToxicityParameters()))
    return scored.select("doc_id", F.coalesce(crc_mod3(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: Folded, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold; texts cross to Python once. No shuffle.

    Null or empty texts and rows without a doc_id stay as their score says.
    Repeated rows stay or go together. Columns of any name pass.
    """
    names = docs.columns
    own = tuple(f"c{i}" for i in range(len(names)))
    return score_documents(docs.toDF(*own), model, own, own[names.index("text")], threshold).drop("__score").toDF(*names)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_toxicity": op2_toxicity}
SQL: dict[str, str] = {}
