"""LM scoring by context-tree weighting over bytes.

The model predicts a document's tokens as bytes, each as eight binary
decisions, the highest bit first. A decision's context is the bits of its byte
so far and up to `depth` bytes before it. Every node of such a context tree
has a Krichevsky-Trofimov estimate of its decisions, and mixes it half and half
with what its longer contexts say, so that all depths are weighed by how well
they code the training texts. The negative logarithm of a document's
probability is its code length.

The corpus is counted as runs of depth + 1 bytes: in the tasks by chunks of
documents, then by run. Runs are kept in order of their context read
backwards, so that every subtree is one range of them, and are cut into blocks
of bounded size. A block works out all subtrees within it; of the contexts at
its two edges, which it may share with its neighbours, it sends sums, and gets
back their weights. Each chunk then gets the values of just the runs and words
that it holds: no table of the model is broadcast or held whole anywhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import _LOWER, _SPACE, drop_tables, runs, span_hashes, stage, string_blocks, table

END = 10
BLANK = 32


@dataclass(frozen=True)
class ContextTreeParameters:
    """depth: bytes of context, 6 at most. Chunks of documents have about chunk_bytes of text, blocks about block_rows runs; neither changes a result."""

    depth: int = 5
    held_out: int = 10
    smoothing: float = 0.1
    chunk_bytes: int = 16 << 20
    block_rows: int = 400_000


# ---------------------------------------------------------------- counting


def token_bytes(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: the stream, each document's first predicted place, and their end.

    A document is each of its words, A-Z lower-cased, with a blank, and then
    an end; `depth` ends stand before it as context of its first bytes.
    """
    inside = ~_SPACE[data]
    starts, ends = runs(inside, offsets)
    n = len(offsets) - 1
    words = np.searchsorted(starts, offsets)
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=kept[1:])
    # every word adds a blank, every document `depth` ends before and one after it
    first = kept[offsets] + words + np.arange(n + 1) * (depth + 1)
    out = np.full(int(first[-1]), BLANK, np.uint8)
    doc = np.searchsorted(offsets[1:], starts, "right")
    at = np.arange(int(kept[-1])) + np.repeat(np.arange(len(starts)) + doc * (depth + 1) + depth, ends - starts)
    out[at] = _LOWER[data[inside]]
    out[first[1:] - 1] = END
    for i in range(depth):
        out[first[:-1] + i] = END
    return out, first[:-1] + depth, first[1:]


def run_keys(stream: np.ndarray, first: np.ndarray, last: np.ndarray, depth: int) -> np.ndarray:
    """A number for each predicted place: the bytes before it, the nearest one highest, and the byte itself lowest."""
    inside = np.zeros(len(stream) + 1, np.int8)
    np.add.at(inside, first, 1)
    np.add.at(inside, last, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    keys = stream[at].astype(np.int64)
    for i in range(1, depth + 1):
        keys |= stream[at - i].astype(np.int64) << (8 * (depth - i + 1))
    return keys


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sum of their counts (1 each if not given)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.diff(np.append(at, len(keys))) if counts is None else np.add.reduceat(counts, at)


class Tally:
    """Counts of keys in parts of bounded size."""

    def __init__(self, most: int = 3_000_000):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.most, self.size = most, 0

    def add(self, keys: np.ndarray, count: bool) -> None:
        keys, n = tally(keys)
        self.parts.append((keys, n if count else np.zeros(len(n), np.int64)))
        self.size += len(keys)
        if self.size > self.most:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [tally(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        keys, n = self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.size = len(keys)
        self.most = max(self.most, 2 * self.size)
        return keys, n


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words, and each document's first word (n + 1 entries)."""
    starts, ends = runs(~_SPACE[data], offsets)
    return span_hashes(_LOWER[data], starts, ends).view(np.int64), np.searchsorted(starts, offsets)


def _spans(keys: np.ndarray, first: np.ndarray, last: np.ndarray, keep: np.ndarray) -> np.ndarray:
    return keys[np.repeat(keep, last - first)]


# ---------------------------------------------------------------- the tree

_HALF = math.log(0.5)
_SMALL = 4096


def _log_gamma_table() -> np.ndarray:
    """ln gamma(i / 2) for i from 1."""
    out = np.zeros(2 * _SMALL + 3)
    out[1] = 0.5 * math.log(math.pi)
    for i in range(3, len(out)):
        out[i] = out[i - 2] + math.log((i - 2) / 2)
    return out


_GAMMA = _log_gamma_table()


def _log_gamma(twice: np.ndarray) -> np.ndarray:
    """ln gamma(twice / 2) of whole numbers from 1."""
    x = np.maximum(twice, 2 * _SMALL) / 2
    far = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(twice <= 2 * _SMALL, _GAMMA[np.minimum(twice, 2 * _SMALL)], far)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(2 * zeros + 1) + _log_gamma(2 * ones + 1) - _log_gamma(2 * (zeros + ones) + 2) - math.log(math.pi)


def own_share(kt: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Weight of a node's own estimate against its longer contexts, from the logarithms of what they give the training bits."""
    return 1 / (1 + np.exp(np.clip(longer - kt, -700, 700)))


class Block:
    """A range of runs of bytes with their counts: its levels, and per bit its nodes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.depth = depth
        self.keys = {depth: keys}
        self.counts = {depth: counts}
        self.up: dict[int, np.ndarray] = {}
        for d in range(depth - 1, -1, -1):
            below = self.keys[d + 1]
            shorter = ((below >> 16) << 8) | (below & 255)
            self.keys[d], self.up[d] = np.unique(shorter, return_inverse=True)
            self.counts[d] = np.bincount(self.up[d], self.counts[d + 1], len(self.keys[d])).astype(np.int64)

    def nodes(self, bit: int):
        """By depth: first entry of each node, node of each entry, zeros, ones, node of the next shorter context, whether the context is at an edge, id."""
        out = {}
        for d in range(self.depth + 1):
            keys, counts = self.keys[d], self.counts[d]
            node = keys >> (8 - bit)
            new = np.append(True, node[1:] != node[:-1])
            first, which = np.flatnonzero(new), np.cumsum(new) - 1
            one = (keys >> (7 - bit)) & 1
            ones = np.bincount(which, counts * one, len(first)).astype(np.int64)
            zeros = np.bincount(which, counts * (1 - one), len(first)).astype(np.int64)
            context = keys[first] >> 8
            edge = (context == keys[0] >> 8) | (context == keys[-1] >> 8)
            inner = (1 << bit) | ((keys[first] & 255) >> (8 - bit))
            ident = (np.int64(d) << 56) | (context << 8) | inner
            parent = None if d == 0 else out[d - 1][1][self.up[d - 1][first]]
            out[d] = (first, which, zeros, ones, parent, edge, ident)
        return out


def _upward(nodes, depth: int):
    """By depth: ln KT and the sum over longer contexts within the block (those at an edge not included), from the deepest up."""
    kt, longer = {}, {}
    longer[depth] = np.zeros(len(nodes[depth][0]))
    for d in range(depth, -1, -1):
        _, _, zeros, ones, parent, edge, _ = nodes[d]
        kt[d] = log_kt(zeros, ones)
        whole = kt[d] if d == depth else _HALF + np.logaddexp(kt[d], longer[d])
        if d:
            longer[d - 1] = np.bincount(parent, np.where(edge, 0, whole), len(nodes[d - 1][0]))
    return kt, longer


def edge_sums(block: Block) -> tuple[np.ndarray, ...]:
    """id, zeros, ones, sum over longer contexts: of the nodes whose contexts may go on in another block."""
    found = []
    for bit in range(8):
        nodes = block.nodes(bit)
        _, longer = _upward(nodes, block.depth)
        for d in range(block.depth + 1):
            _, _, zeros, ones, _, edge, ident = nodes[d]
            found.append((ident[edge], zeros[edge], ones[edge], longer[d][edge]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def edge_weights(ident: np.ndarray, zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id in order; the probability of a one from this and shorter contexts, and the weight left to longer ones. The shorter contexts of an edge are edges too."""
    order = np.argsort(ident)
    ident, zeros, ones, longer = ident[order], zeros[order], ones[order], longer[order].copy()
    level = ident >> 56
    shorter = ((level - 1) << 56) | (((ident >> 16) & ((1 << 40) - 1)) << 8) | (ident & 255)
    parent = np.searchsorted(ident, shorter)
    kt = log_kt(zeros, ones)
    for d in range(depth, 0, -1):
        at = np.flatnonzero(level == d)
        whole = kt[at] if d == depth else _HALF + np.logaddexp(kt[at], longer[at])
        np.add.at(longer, parent[at], whole)
    one = (ones + 0.5) / (zeros + ones + 1)
    share = np.where(level == depth, 1.0, own_share(kt, longer))
    so_far, left = np.zeros(len(ident)), np.ones(len(ident))
    for d in range(depth + 1):
        at = np.flatnonzero(level == d)
        before, rest = (so_far[parent[at]], left[parent[at]]) if d else (0.0, 1.0)
        so_far[at] = before + rest * share[at] * one[at]
        left[at] = rest * (1 - share[at])
    return ident, so_far, left


def run_logs(block: Block, edges: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Natural logarithm of the probability of each run's last byte after its others."""
    known, edge_one, edge_left = edges
    out = np.zeros(len(block.keys[block.depth]))
    for bit in range(8):
        nodes = block.nodes(bit)
        kt, longer = _upward(nodes, block.depth)
        so_far, left = np.zeros(1), np.ones(1)
        for d in range(block.depth + 1):
            _, _, zeros, ones, parent, edge, ident = nodes[d]
            before, rest = (so_far[parent], left[parent]) if d else (np.zeros(len(zeros)), np.ones(len(zeros)))
            share = 1.0 if d == block.depth else own_share(kt[d], longer[d])
            so_far = before + rest * share * (ones + 0.5) / (zeros + ones + 1)
            left = rest * (1 - share)
            at = np.searchsorted(known, ident[edge])
            so_far[edge], left[edge] = edge_one[at], edge_left[at]
        one = so_far[nodes[block.depth][1]]
        is_one = (block.keys[block.depth] >> (7 - bit)) & 1
        out += np.log(np.where(is_one == 1, one, 1 - one))
    return out


# ---------------------------------------------------------------- Spark side

_BLOBS = "kind int, block int, chunk int, keys binary, counts binary, size int"
_VALUES = "chunk int, kind int, keys binary, counts binary, size int"
_EDGES = "ident long, zeros long, ones long, longer double"
RUNS, WORDS = 0, 1


def _packed(keys: np.ndarray, values: np.ndarray) -> tuple[bytes, bytes, int]:
    """Sorted keys as differences, and their values, compressed; and how many."""
    steps = np.diff(keys, prepend=np.int64(0))
    return pa.compress(steps.tobytes(), "zstd", asbytes=True), pa.compress(values.tobytes(), "zstd", asbytes=True), len(keys)


def _unpacked(keys: bytes, values: bytes, size: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    steps = np.frombuffer(pa.decompress(keys, 8 * size, "zstd", asbytes=True), np.int64)
    return np.cumsum(steps), np.frombuffer(pa.decompress(values, 8 * size, "zstd", asbytes=True), kind)


def _parts(found: pa.Table, kind: type) -> list[tuple[np.ndarray, np.ndarray]]:
    return [_unpacked(*x, kind) for x in zip(*(found.column(c).to_pylist() for c in ("keys", "counts", "size")), strict=True)]


def _chunk_counts(texts: pa.ChunkedArray, learn: np.ndarray, depth: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The runs and words of a chunk with their training counts (0 where only documents have them that aren't learned from)."""
    tallies, at = {RUNS: Tally(), WORDS: Tally()}, 0
    for column in texts.chunks:
        for a, b, data, offsets in string_blocks(column):
            mine = learn[at + a : at + b]
            stream, first, last = token_bytes(data, offsets, depth)
            keys = run_keys(stream, first, last, depth)
            words, bounds = word_keys(data, offsets)
            for flag in (True, False):
                tallies[RUNS].add(_spans(keys, first, last, mine == flag), flag)
                tallies[WORDS].add(_spans(words, bounds[:-1], bounds[1:], mine == flag), flag)
        at += len(column)
    return {kind: t.merge() for kind, t in tallies.items()}


def _cuts(docs: DataFrame, total: int, p: ContextTreeParameters, sample_bytes: int = 8 << 20, parts: int = 16) -> np.ndarray:
    """First keys of blocks 1, 2, ... of runs, from a sample of documents of about sample_bytes: it decides the size of blocks alone, never a result."""
    texts = docs.select("text").sample(min(1.0, sample_bytes / max(total, 1)), seed=1).toPandas()["text"]
    rows, bytes_seen = [], 0
    for i in range(parts):
        found = Tally()
        for a, _, data, offsets in string_blocks(pa.array(texts[i::parts], pa.string())):
            found.add(run_keys(*token_bytes(data, offsets, p.depth), p.depth), True)
            bytes_seen += len(data)
        rows.append(found.merge()[0])
    rows = np.sort(np.concatenate(rows))
    blocks = math.ceil(total * len(rows) / max(bytes_seen, 1) / p.block_rows)
    return np.unique(rows[(np.arange(1, blocks) * len(rows)) // blocks]) if blocks > 1 and len(rows) else np.zeros(0, np.int64)


def _count(docs: DataFrame, cuts: np.ndarray, word_blocks: int, p: ContextTreeParameters) -> DataFrame:
    """Runs and words of each chunk, cut into blocks: one row for each kind, block and chunk."""

    def count(key: tuple, group: pa.Table) -> pa.Table:
        drop_tables()
        learn = group.column("learn").to_numpy(zero_copy_only=False).astype(bool)
        rows = []
        for kind, (keys, n) in _chunk_counts(group.column("text"), learn, p.depth).items():
            first = cuts if kind == RUNS else np.linspace(-(2.0**63), 2.0**63, word_blocks + 1)[1:-1].astype(np.int64)
            bounds = np.concatenate([[0], np.searchsorted(keys, first), [len(keys)]])
            rows += [(kind, i, key[0].as_py(), *_packed(keys[a:b], n[a:b])) for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if b > a]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "block", "chunk", "keys", "counts", "size"])

    return docs.select("chunk", "learn", "text").groupBy("chunk").applyInArrow(count, _BLOBS)


def _block_edges(counted: DataFrame, depth: int) -> DataFrame:
    """The sums of the contexts at the edges of each block of runs."""

    def sums(group: pa.Table) -> pa.Table:
        keys, n = tally(*(np.concatenate(x) for x in zip(*_parts(group, np.int64), strict=True)))
        found = edge_sums(Block(keys, n, depth))
        return pa.table([pa.array(x) for x in found], names=["ident", "zeros", "ones", "longer"])

    each = counted.where(F.col("kind") == RUNS).groupBy("block").applyInArrow(sums, _EDGES)
    return each.groupBy("ident").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "longer")))


def _word_totals(counted: DataFrame) -> tuple[int, int]:
    """Training words, and how many are different."""

    def totals(group: pa.Table) -> pa.Table:
        _, n = tally(*(np.concatenate(x) for x in zip(*_parts(group, np.int64), strict=True)))
        return pa.table([pa.array([int(n.sum())]), pa.array([int((n > 0).sum())])], names=["tokens", "types"])

    found = counted.where(F.col("kind") == WORDS).groupBy("block").applyInArrow(totals, "tokens long, types long")
    row = found.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()
    return row.n, row.v


def _values(counted: DataFrame, edges: tuple[np.ndarray, ...], depth: int) -> DataFrame:
    """For each chunk the values of its own runs (logarithms of probabilities) and words (training counts)."""
    shared = counted.sparkSession.sparkContext.broadcast(edges)

    def values(key: tuple, group: pa.Table) -> pa.Table:
        parts = _parts(group, np.int64)
        keys, n = tally(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        kind = key[0].as_py()
        out = run_logs(Block(keys, n, depth), shared.value) if kind == RUNS else n
        packed = [_packed(own, out[np.searchsorted(keys, own)]) for own, _ in parts]
        columns = [group.column("chunk").combine_chunks(), pa.array([kind] * len(parts), pa.int32()), *(pa.array(c, t) for c, t in zip(zip(*packed, strict=True), (pa.binary(), pa.binary(), pa.int32()), strict=True))]
        return pa.table(columns, names=["chunk", "kind", "keys", "counts", "size"])

    return counted.groupBy("kind", "block").applyInArrow(values, _VALUES)


def _found(values: pa.Table, kind: int, as_type: type) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's keys in order and their values."""
    parts = _parts(values.filter(pa.compute.equal(values.column("kind"), kind)), as_type)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, as_type)
    keys, out = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    return keys[order], out[order]


def _score_texts(texts: pa.ChunkedArray, logs: tuple, counts: tuple, ends: int, smoothing: float, depth: int) -> list[np.ndarray]:
    """n_tokens, n_known, sum of log10(count + smoothing), n_bytes, log10 probability, of each text."""
    found = []
    for column in texts.chunks:
        for _, _, data, offsets in string_blocks(column):
            stream, first, last = token_bytes(data, offsets, depth)
            kinds, which = np.unique(run_keys(stream, first, last, depth), return_inverse=True)
            value = logs[1][np.searchsorted(logs[0], kinds)][which]
            sizes = last - first
            log = np.add.reduceat(value, np.cumsum(sizes) - sizes) / math.log(10)
            words, bounds = word_keys(data, offsets)
            c = counts[1][np.searchsorted(counts[0], words)] if len(words) else np.zeros(0, np.int64)
            sums = np.concatenate([[0], np.cumsum(np.log10(c + smoothing))])
            known = np.concatenate([[0], np.cumsum(c > 0)])
            n = np.diff(bounds)
            found.append((n + 1, np.diff(known[bounds]) + (ends > 0), sums[bounds[1:]] - sums[bounds[:-1]] + math.log10(ends + smoothing), sizes, log))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0)] * 5


def score_documents(docs: DataFrame, p: ContextTreeParameters | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every row.

    score is the log10 probability of the text by a context tree of the rows
    that aren't held out (checksum of the id modulo held_out is 0);
    bits_per_byte is its code length by byte of its tokens, each with a blank,
    and its end. base_score is that of single tokens with added smoothing.

    Null and empty texts are a lone end. Rows without a doc_id are neither held
    out nor learned from; repeated rows are learned from as often as they
    stand. Whole texts of any length count. No training rows: every bit is as
    likely as not, and base_score is 0. An empty table gives no rows; other
    columns, whatever their names, are ignored.
    """
    p = p or ContextTreeParameters()
    if not 0 <= p.depth <= 6:
        raise ValueError("a run of bytes must fit into 56 bits: depth is 0 to 6")
    spark = docs.sparkSession
    check = F.crc32(F.col("doc_id").cast("string").cast("binary")) % p.held_out
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(check == 0, F.lit(False)).alias("held_out"), F.coalesce(check != 0, F.lit(False)).alias("learn"))
    seen = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.col("learn").cast("long")), F.lit(0)).alias("learned")).first()
    chunks = max(math.ceil(seen.bytes / p.chunk_bytes), 2 * spark.sparkContext.defaultParallelism)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    cuts = _cuts(rows, seen.bytes, p)
    counted = stage(_count(rows, cuts, len(cuts) + 1, p), "lm-counts")
    # to the driver come at most 2 * (depth + 1) contexts of 255 nodes for each block
    sent = _block_edges(counted, p.depth).toPandas()
    edges = edge_weights(*(sent[c].to_numpy() for c in ("ident", "zeros", "ones", "longer")), p.depth)
    tokens, types = _word_totals(counted)
    ends = seen.learned
    tokens, types = tokens + ends, types + (ends > 0)
    total = math.log10(tokens + p.smoothing * (types + 1))
    values = _values(counted, edges, p.depth)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]

    def score(mine: pa.Table, found: pa.Table) -> pa.Table:
        drop_tables()
        n, known, base, size, log = _score_texts(mine.column("text"), _found(found, RUNS, np.float64), _found(found, WORDS, np.int64), ends, p.smoothing, p.depth)
        columns = [mine.column("doc_id"), mine.column("held_out"), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), tokens, np.int64)), pa.array(base - n * total), pa.array(log.astype(np.float64)), pa.array(size.astype(np.int64)), pa.array(-log * math.log2(10) / np.maximum(size, 1))]
        return pa.table(columns, names=names)

    schema = rows.select("doc_id", "held_out").schema.add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double").add("n_bytes", "long").add("bits_per_byte", "double")
    return rows.select("chunk", "doc_id", "held_out", "text").groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(score, schema)


def op12_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op12_context_tree": op12_context_tree}
SQL: dict[str, str] = {}
