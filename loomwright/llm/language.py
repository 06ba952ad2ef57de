"""Language ID of mixed texts: script ranges, per-word scores, Viterbi with a switching penalty.

The script of a word's first letter leaves only languages that were learned
with that script. A word's score in a language is the mean log probability of
its hashed character n-grams and itself, times the number of its letters up
to a bound. The best path through the words of a text, at a price for each
change of language, labels its spans; the text's language is the one whose
spans hold most letters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import crc_mod3, drop_tables, string_blocks, table
from loomwright.llm.subwords import Words, bounded_sample, distinct, grams, texts_block, training_part, words_of

#: First code points of the ranges of a script, in order; -1: no script of its own. Fixed values.
SCRIPT_STARTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "other"), (0x0750, "Arabic"),
    (0x0780, "other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "other"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "other"), (0x1C80, "Cyrillic"),
    (0x1C90, "Georgian"), (0x1CC0, "other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C00, "other"), (0x2C60, "Latin"), (0x2C80, "other"),
    (0x2DE0, "Cyrillic"), (0x2E00, "other"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "other"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"),
    (0x3200, "Han"), (0xA000, "other"), (0xA640, "Cyrillic"), (0xA6A0, "other"), (0xA720, "Latin"), (0xA800, "other"), (0xAC00, "Hangul"), (0xD800, "other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "other"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "other"), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "other"), (0x20000, "Han"), (0x32000, "other"),
)
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})
_STARTS = np.array([a for a, _ in SCRIPT_STARTS])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_STARTS])


@dataclass(frozen=True)
class LanguageParameters:
    """Training rows are bounded: per_language texts of each language, of up to train_chars."""

    per_language: int = 1500
    train_chars: int = 20_000
    sizes: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    smoothing: float = 0.5
    switch: float = 12.0
    most_letters: int = 8
    #: A language is a candidate for a script that holds this share of its training letters.
    least_share: float = 0.02


_letter: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    if not _letter:
        _letter.append(np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)]))
    return _letter[0]


def word_letters(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each word, and the script of its first letter."""
    is_letter = letters()[w.points]
    total = np.concatenate([[0], np.cumsum(is_letter)])
    many = total[w.ends] - total[w.starts]
    at = np.flatnonzero(is_letter)
    first = np.zeros(w.count, np.int64)
    some = many > 0
    if some.any():
        first[some] = w.points[at[np.searchsorted(at, w.starts[some])]]
    return many, _SCRIPT[np.searchsorted(_STARTS, first, "right") - 1]


class LanguageModel:
    """Log probabilities of n-gram buckets by language; which languages are written in which script."""

    def __init__(self, names: list[str], logs: np.ndarray, written: np.ndarray, p: LanguageParameters):
        self.names, self.logs, self.written, self.p = names, logs.astype(np.float32), written, p

    def word_scores(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(words x languages) scores, 0 for words without letters; letters of each word."""
        many, script = word_letters(w)
        out = np.zeros((w.count, len(self.names)), np.float32)
        count = np.zeros(w.count)
        for word, bucket in grams(w, self.p.sizes, self.p.bits):
            for k in range(len(self.names)):
                out[:, k] += np.bincount(word, self.logs[k][bucket], w.count)
            count += np.bincount(word, minlength=w.count)
        out *= (np.minimum(many, self.p.most_letters) / np.maximum(count, 1))[:, None]
        allowed = self.written[script]
        narrowed = (many > 0) & allowed.any(axis=1)
        out[narrowed] = np.where(allowed[narrowed], out[narrowed], out[narrowed].min(axis=1, initial=0, keepdims=True) - 50)
        out[many == 0] = 0
        return out - out.max(axis=1, initial=-np.inf, keepdims=True) if w.count else out, many

    def label(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
        """Words of a block, the language number of each, and its letters."""
        w = words_of(data, offsets)
        kinds, which = distinct(w)
        scores, many = self.word_scores(kinds)
        return w, viterbi(scores[which], w.first, self.p.switch), many[which]


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float, cells: int = 1 << 20) -> np.ndarray:
    """The best path of each text (rows first[i] to first[i + 1]), all texts of about one length step by step together."""
    kind = np.min_scalar_type(max(1, scores.shape[1] - 1))
    labels = np.zeros(len(scores), kind)
    size = np.diff(first)
    if not len(scores):
        return labels
    states = scores.shape[1]
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    a = 0
    while a < len(order):
        longest = int(size[order[a]])
        b = min(len(order), a + max(1, cells // (longest * states)))
        some = order[a:b]  # from long to short
        begin, length = first[some], size[some]
        active = np.searchsorted(-length, -np.arange(1, longest + 1), "right")  # texts with more than t words
        best = scores[begin].astype(np.float64)
        came = np.zeros((longest, len(some), states), kind)
        keep = np.arange(states, dtype=kind)
        for t in range(1, longest):
            n = active[t]
            top = best[:n].argmax(axis=1)
            leave = best[np.arange(n), top] - switch
            move = leave[:, None] > best[:n]
            came[t, :n] = np.where(move, top[:, None].astype(kind), keep)
            best[:n] = np.where(move, leave[:, None], best[:n]) + scores[begin[:n] + t]
        state = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            n = active[t]
            labels[begin[:n] + t] = state[:n]
            if t:
                state[:n] = came[t, np.arange(n), state[:n]]
        a = b
    return labels


def train(texts: list[str], langs: list[str], p: LanguageParameters) -> LanguageModel:
    """Counts of n-gram buckets by language, each text weighted equally up to its length; no texts: no languages."""
    names = sorted(set(langs))
    counts = np.zeros((len(names), 1 << p.bits))
    written = np.zeros((len(SCRIPTS), len(names)))
    for k, name in enumerate(names):
        mine = sorted(t for t, lang in zip(texts, langs, strict=True) if lang == name)
        for a in range(0, len(mine), 200):
            w = words_of(*texts_block(mine[a : a + 200]))
            many, script = word_letters(w)
            written[:, k] += np.bincount(script, many, len(SCRIPTS))
            for word, bucket in grams(w, p.sizes, p.bits):
                counts[k] += np.bincount(bucket, many[word] > 0, 1 << p.bits)
    logs = np.log(counts + p.smoothing) - np.log(counts.sum(axis=1, keepdims=True) + p.smoothing * (1 << p.bits))
    return LanguageModel(names, logs, written >= p.least_share * np.maximum(written.sum(axis=0), 1), p)


def fit(docs: DataFrame, p: LanguageParameters) -> LanguageModel:
    """Learn from documents with a language whose crc32 of the id modulo 3 isn't 1."""
    rows = training_part(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= p.train_chars)))
    ids = bounded_sample(rows.select("doc_id", F.col("lang").alias("__lang")).distinct(), "__lang", p.per_language)
    found = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "__lang"]).select("text", "__lang").toPandas()
    return train(found["text"].tolist(), found["__lang"].tolist(), p)


def identify(docs: DataFrame, model: LanguageModel, spans: bool = False, id_column: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score (share of the letters in spans of lang_pred); with spans also spans: array of (first_word, n_words, lang).

    Words are runs of characters that aren't white space. Text that is null or
    has no letter: `und`, score 0, no spans. Ties go to the language that comes
    first by name. Without learned languages all is `und`. Repeated rows give
    repeated results; null ids stay null; other columns are ignored. Long texts
    are labelled whole. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        m = shared.value
        names = np.array([*m.names, "und"], object)
        for batch in batches:
            for a, b, data, offsets in string_blocks(batch.column(1), 2 << 20):
                n = b - a
                if m.names:
                    w, labels, many = m.label(data, offsets)
                    doc = np.repeat(np.arange(n), np.diff(w.first))
                    held = np.bincount(doc * len(m.names) + labels.astype(np.int64), many, n * len(m.names)).reshape(n, -1)
                else:
                    held = np.zeros((n, 1))
                total = held.sum(axis=1)
                best = np.where(total > 0, held.argmax(axis=1), len(m.names))
                score = held.max(axis=1) / np.maximum(total, 1)
                columns = [batch.column(0).slice(a, n), pa.array(names[best].tolist(), pa.string()), pa.array(score)]
                if spans:
                    found = [_spans(labels[x:y], m.names) if total[i] > 0 else [] for i, (x, y) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True))] if m.names else [[]] * n
                    columns.append(pa.array(found, pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "lang_pred", "score", "spans"][: len(columns)])

    schema = f"`{id_column}` {kind}, lang_pred string, score double" + (", spans array<struct<first_word:int,n_words:int,lang:string>>" if spans else "")
    return docs.select(id_column, "text").mapInArrow(run, schema)


def _spans(labels: np.ndarray, names: list[str]) -> list[dict]:
    start = np.flatnonzero(np.append(True, labels[1:] != labels[:-1]))
    end = np.append(start[1:], len(labels))
    return [{"first_word": a, "n_words": b - a, "lang": names[labels[a]]} for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs.select("doc_id", "text", "lang"), LanguageParameters()))
    return found.select("doc_id", F.coalesce(crc_mod3(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language": op4_language}
SQL: dict[str, str] = {}
