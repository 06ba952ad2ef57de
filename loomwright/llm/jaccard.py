"""N-gram Jaccard join by parity sketches, and its connected groups.

A document is the set of its word shingles. Shingles are dealt by hash over
blocks and XORed into their block, so two sets differ in at most as many
blocks as their symmetric difference has members, which a similarity bounds.
Sets of a size band use one number of blocks, one more than that bound:
linked sets then agree in a block (pigeonhole). A set sends its first
(bound + 1) blocks that aren't empty. Where it has fewer, its members stand
close together in few blocks; it then sends those, and its first members in
hash order: of two linked sets of this kind, whose blocks may all differ but
the empty ones, those overlap (prefix filter). So the empty block, which
unrelated short texts share, is no bucket. Sets that share a key are
candidates. A smaller bit sketch, whose Hamming
distance also lies below the symmetric difference, discards most wrong
candidates, and the shingles of both texts decide the rest.

Groups need not verify all pairs: small buckets give all their pairs, larger
ones a star around one member. In buckets that still hold several components
after that, the sketches of members of different components are compared in
tiles, inside the tasks: first the nearest pair of any two components is
verified, then all that are near enough. So no link between components is
lost and no bucket's pairs are written out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import ascii_words, checked_broadcast, drop_tables, mix, release, spread_join, stage, stage_by, string_blocks, table
from loomwright.llm.components import connected

#: Sizes of one band differ by less than this factor.
BAND = 1.5
#: Buckets up to this many sets give all their pairs.
SMALL = 6
#: From so many sets of one bucket in a task on, the task sends one of them for all.
LOCAL = 16
#: Sets whose sketches may be broadcast: some 100 bytes each, of sets of many members more.
SKETCHES = 50_000
#: Keys that a task holds before it sends them, each key and set once.
COMBINED = 250_000
#: Members of one tile of a bucket.
TILE = 512
#: Pairs with one hub that a task verifies; a hub's text is sent once for each so many.
HUB = 256


class Rule:
    """Similarity p / q over shingles of k words: bands and bounds in whole numbers.

    clash: hashes that several sets share; those sets go by their second hash.
    hash_bits: of the first hash (fewer in tests, so that sets clash).
    """

    def __init__(self, k: int, p: int, q: int, hash_bits: int = 64):
        self.k, self.p, self.q = k, p, q
        self.clash = np.zeros(0, np.int64)
        self.shift = np.uint64(64 - hash_bits)
        self.high = [1]
        while self.high[-1] < 1 << 40:
            self.high.append(max(self.high[-1] + 1, int(self.high[-1] * BAND)))
        self.high_array = np.array(self.high, np.int64)
        self.blocks = np.array([self.bound(h) + 1 for h in self.high], np.int64)

    def bound(self, a: int, b: int | None = None) -> int:
        """The largest symmetric difference of linked sets of a and b members, a being the smaller (b None: any)."""
        b = a * self.q // self.p if b is None else b
        return (a + b) * (self.q - self.p) // (self.q + self.p)

    def names(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What each set goes by: its first hash, or its second where the first is shared."""
        out = (set_hashes(hashes, first).view(np.uint64) >> self.shift).view(np.int64)
        shared = np.isin(out, self.clash)
        return np.where(shared, set_hashes(hashes, first, 1), out) if shared.any() else out

    def linked(self, common: int, a: int, b: int) -> bool:
        return a > 0 and b > 0 and self.q * common >= self.p * (a + b - common)


# ------------------------------------------------------------ sets of a block of texts


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents of a block, and each document's first (n + 1 entries)."""
    words, first = ascii_words(data, offsets)
    counts = np.diff(first)
    total = len(words)
    parts, step = np.zeros(total, np.uint64), 0xD6E8FEB86659FD93
    for i in range(k):
        parts[: total - i] += words[i:] * np.uint64(pow(step, i + 1, 1 << 64) | 1)
    hashes = mix(parts)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    start = np.concatenate([[0], np.cumsum(n)])
    out = hashes[np.arange(start[-1]) + np.repeat(first[:-1] - start[:-1], n)]
    for i in np.flatnonzero((counts > 0) & (counts < k)).tolist():  # the whole sequence as one
        h = int(counts[i])
        for w in words[first[i] : first[i + 1]].tolist():
            h = (h * step ^ w) * 0x9FB21C651E98DF25 % (1 << 64)
        out[start[i]] = mix(np.array([h], np.uint64))[0]
    for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[start[:-1][n > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[start]


def set_hashes(hashes: np.ndarray, first: np.ndarray, seed: int = 0) -> np.ndarray:
    """One hash per set, for each seed another one; 0 for the empty set."""
    salt = np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[seed])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes * (salt | np.uint64(1)) ^ salt))])
    n = np.diff(first)
    out = mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64))
    return np.where(n > 0, np.maximum(out, np.uint64(1)), np.uint64(0)).view(np.int64)


def bit_sketch(hashes: np.ndarray) -> bytes:
    """Parities of hash cells, 2 to 4 cells for a member; a longer sketch folds to a shorter one by XOR of neighbours."""
    bits = max(8, 2 << int(len(hashes) - 1).bit_length()) if len(hashes) else 8
    cell = (hashes >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=bits) & 1).astype(np.uint8)).tobytes()


#: By byte: the XORs of its neighbouring bits, as four bits.
_HALF = np.array([sum((b >> 2 * i & 1 ^ b >> 2 * i + 1 & 1) << i for i in range(4)) for b in range(256)], np.uint8)


def fold(sketches: np.ndarray, size: int) -> np.ndarray:
    """Rows of packed sketches folded to `size` bytes."""
    while sketches.shape[1] > size:
        half = _HALF[sketches]
        sketches = half[:, 0::2] << 4 | half[:, 1::2]
    return sketches


def distances(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Hamming distance of each two sketches, at the length of the shorter."""
    sides = []
    for c in (x, y):
        at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
        sides.append((np.frombuffer(c.buffers()[2] or b"", np.uint8), at[:-1], np.diff(at)))
    (data_x, at_x, size_x), (data_y, at_y, size_y) = sides
    out = np.zeros(len(x), np.int64)
    for a, b in np.unique(np.stack([size_x, size_y], axis=1), axis=0).tolist():
        rows = np.flatnonzero((size_x == a) & (size_y == b))
        for i in range(0, len(rows), max(1, (1 << 20) // max(a, b))):
            some = rows[i : i + max(1, (1 << 20) // max(a, b))]
            one = fold(data_x[at_x[some][:, None] + np.arange(a)], min(a, b))
            two = fold(data_y[at_y[some][:, None] + np.arange(b)], min(a, b))
            out[some] = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)
    return out


def block_keys(rule: Rule, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set number, key) of the blocks that each set of a block of texts sends, over its own band and the lower ones it can reach."""
    n = np.diff(first)
    own = np.searchsorted(rule.high_array, n)
    low = np.searchsorted(rule.high_array, -(-n * rule.p // rule.q))
    numbers, keys = [], []
    down = 0
    while True:
        sets = np.flatnonzero((n > 0) & (own - down >= low))
        if not len(sets):
            break
        band = own[sets] - down
        high = rule.high_array[band]
        bound = np.array([rule.bound(a) if a <= h else rule.bound(h, a) for a, h in zip(n[sets].tolist(), high.tolist(), strict=True)], np.int64)
        blocks = rule.blocks[band]
        size = n[sets]
        which = np.repeat(np.arange(len(sets)), size)
        s = hashes[np.arange(size.sum()) + np.repeat(first[sets] - np.cumsum(size) + size, size)]
        block = ((s >> np.uint64(32)) * blocks[which].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        new = np.ones(len(s), bool)
        new[1:] = (block[1:] != block[:-1]) | (which[1:] != which[:-1])
        at = np.flatnonzero(new)
        value, holder, block = np.bitwise_xor.reduceat(s, at), which[at], block[at]
        full = np.bincount(holder, minlength=len(sets))
        start = np.cumsum(full) - full
        send = np.arange(len(holder)) - start[holder] <= bound[holder]
        holder, block, value = holder[send], block[send], value[send]
        tag = mix((band[holder].astype(np.uint64) << np.uint64(40)) + block.astype(np.uint64))
        numbers.append(sets[holder])
        keys.append(mix(value + tag))
        # too few blocks: the first members in hash order (members are sorted), enough that linked sets share one
        lone = np.flatnonzero(full <= bound)
        if len(lone):
            many = size[lone] + (-size[lone] * rule.p) // rule.q + 1
            ends = np.cumsum(many)
            numbers.append(np.repeat(sets[lone], many))
            keys.append(mix(hashes[np.arange(ends[-1]) + np.repeat(first[sets[lone]] - ends + many, many)] ^ np.uint64(0xA0761D6478BD642F)))
        down += 1
    if not numbers:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(numbers), np.concatenate(keys).view(np.int64)


# ------------------------------------------------------------ Spark steps


def describe(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n (members), h (hash of the set), h2 (a second one), sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        for batch in batches:
            for a, b, data, offsets in string_blocks(batch.column(1)):
                hashes, first = sets_of(data, offsets, rule.k)
                sketches = [bit_sketch(hashes[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(np.diff(first).astype(np.int64)), pa.array(rule.names(hashes, first)), pa.array(set_hashes(hashes, first, 1)), pa.array(sketches, pa.binary())], names=["doc_id", "n", "h", "h2", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h long, h2 long, sketch binary")


_KEYS = "kind byte, key long, h long"


def _bucket_rows(docs: DataFrame, rule: Rule) -> DataFrame:
    """kind, key, h. kind 0: h sends key. kind 1: one set stands for more than LOCAL in its task. kind 2: a member that was stood for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for _, _, data, offsets in string_blocks(batch.column(0)):
                hashes, first = sets_of(data, offsets, rule.k)
                number, key = block_keys(rule, hashes, first)
                held.append((key, rule.names(hashes, first)[number]))
                size += len(key)
                if size > COMBINED:
                    yield _combine(held)
                    held, size = [], 0
        if held:
            yield _combine(held)

    return docs.where("text is not null").select("text").mapInArrow(run, _KEYS)


def _combine(held) -> pa.RecordBatch:
    key, h = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((h, key))
    key, h = key[order], h[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
    key, h = key[new], h[new]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    many = np.diff(np.append(start, len(key)))
    kind = np.repeat(np.where(many > LOCAL, 2, 0), many).astype(np.int8)
    hot = start[many > LOCAL]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([kind, np.ones(len(hot), np.int8)])), pa.array(np.concatenate([key, key[hot]])), pa.array(np.concatenate([h, h[hot]]))],
        names=["kind", "key", "h"],
    )


def _candidates(rows: DataFrame) -> DataFrame:
    """kind, a, b: kind 3: pair (a, b) of sets, a of them the one that a star hangs on b; kind 2: member b of the large bucket a."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by key; a bucket's rows may go over the end of a batch
        rest: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cut = int(np.searchsorted(now[1], now[1][-1])) if len(now[1]) else 0
            rest = [x[cut:] for x in now]
            if cut:
                yield _bucket_pairs(*(x[:cut] for x in now))
        if rest is not None and len(rest[0]):
            yield _bucket_pairs(*rest)
        release()

    # whole tasks of keys; one task of the step before sends at most LOCAL rows of one key
    dealt = rows.where("kind < 2").repartition(F.col("key")).sortWithinPartitions("key", "h")
    pairs = dealt.mapInArrow(run, "kind byte, a long, b long")
    return pairs.unionByName(rows.where("kind = 2").select("kind", F.col("key").alias("a"), F.col("h").alias("b")))


def _bucket_pairs(kind: np.ndarray, key: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    many = np.diff(np.append(start, len(key)))
    hot = np.maximum.reduceat(kind, start) > 0
    keep = np.repeat((many > 1) | hot, many)
    key, h, kind = key[keep], h[keep], kind[keep]
    if not len(key):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int8()), pa.array([], pa.int64()), pa.array([], pa.int64())], names=["kind", "a", "b"])
    new = np.append(True, (key[1:] != key[:-1]) | (h[1:] != h[:-1]))
    key, h = key[new], h[new]
    hot_key = np.unique(key[np.isin(key, key[new.cumsum()[kind > 0] - 1])]) if (kind > 0).any() else np.zeros(0, np.int64)
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    many = np.diff(np.append(start, len(key)))
    hot = np.isin(key[start], hot_key)
    kinds, a, b = [], [], []
    position = np.arange(len(key)) - np.repeat(start, many)
    large = np.repeat((many > SMALL) | hot, many)
    # all pairs of small buckets, members of large ones; the star of both is on the first member
    for back in range(1, SMALL):
        use = np.flatnonzero((position >= back) & ~large) if back > 1 else np.flatnonzero(position >= 1)
        a.append(h[use])
        b.append(h[use - back])
        kinds.append(np.full(len(use), 3 if back == 1 else 4, np.int8))
    star = np.flatnonzero(position >= 2)
    a.append(h[star])
    b.append(h[np.repeat(start, many)[star]])
    kinds.append(np.full(len(star), 3, np.int8))
    use = np.flatnonzero(large)
    a.append(key[use])
    b.append(h[use])
    kinds.append(np.full(len(use), 2, np.int8))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["kind", "a", "b"])


def _near_in_sketch(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose sizes and sketches allow a link, staged: sketches are by far the widest rows, so they are joined once. sets: h, n, sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            fit = np.flatnonzero(rule.p * np.maximum(n, m) <= rule.q * np.minimum(n, m))
            some = batch.take(pa.array(fit))
            far = distances(some.column(3), some.column(5))
            yield some.select([0, 1]).filter(pa.array(far <= (n + m)[fit] * (rule.q - rule.p) // (rule.q + rule.p)))

    one = sets.select(F.col("h").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    two = sets.select(F.col("h").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    pairs = stage(pairs.select("a", "b"), "to-compare")
    met = spread_join(spread_join(pairs, one, "a", "inner", SKETCHES), two, "b", "inner", SKETCHES, counted=pairs)
    return stage(met.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(run, "a long, b long"), "near-pairs")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of set hashes that are links, by the shingles of both texts. pairs: staged; sets: h, doc_id (one that has the set)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            known: dict[int, np.ndarray] = {}
            wanted = batch.column(1).to_pylist()
            for side in (3, 2):
                for x, y, data, offsets in string_blocks(batch.column(side)):
                    hashes, first = sets_of(data, offsets, rule.k)
                    h = rule.names(hashes, first)
                    for i in range(x, y):
                        s = hashes[first[i - x] : first[i - x + 1]]
                        if side == 3:
                            if h[i - x] == wanted[i] and wanted[i] not in known:
                                known[wanted[i]] = s
                        elif h[i - x] == batch.column(0)[i].as_py() and (t := known.get(wanted[i])) is not None:
                            at = np.searchsorted(t, s)
                            common = int(np.count_nonzero(t[np.minimum(at, len(t) - 1)] == s)) if len(t) else 0
                            good[i] = rule.linked(common, len(s), len(t))
            yield batch.select([0, 1]).filter(pa.array(good))

    # the texts of a pair meet at its second set; one that is in many pairs is dealt over several tasks
    ids = sets.select("h", "doc_id")
    named = spread_join(pairs, ids.select(F.col("h").alias("a"), F.col("doc_id").alias("id_a")), "a", "inner")
    named = stage(spread_join(named, ids.select(F.col("h").alias("b"), F.col("doc_id").alias("id_b")), "b", "inner", counted=pairs).select("a", "b", "id_a", "id_b"), "pairs")
    many = stage(named.groupBy("id_b").agg(F.ceil(F.count(F.lit(1)) / HUB).alias("parts")).where("parts > 1"), "hubs")
    named = spread_join(named, many, "id_b").withColumn("part", F.pmod(F.xxhash64("id_a"), F.coalesce("parts", F.lit(1)))).select("a", "b", "id_a", "id_b", "part")
    named = stage(named, "parted-pairs")
    text = docs.where("text is not null").select("doc_id", "text")
    first = text.withColumnRenamed("text", "text_a").join(checked_broadcast(named), F.col("doc_id") == F.col("id_a")).drop("doc_id")
    wanted = named.select(F.col("id_b").alias("doc_id"), "part").distinct()
    second = text.join(checked_broadcast(wanted), "doc_id").select(F.col("doc_id").alias("id_b"), "part", F.col("text").alias("text_b"))
    return first.join(second, ["id_b", "part"]).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs (staged) whose ends aren't in one component yet."""
    one = component.select(F.col("node").alias("a"), F.col("root").alias("r_a"))
    two = component.select(F.col("node").alias("b"), F.col("root").alias("r_b"))
    return spread_join(spread_join(pairs, one, "a"), two, "b", counted=pairs).where(F.coalesce("r_a", "a") != F.coalesce("r_b", "b")).drop("r_a", "r_b")


def _mixed(members: DataFrame, component: DataFrame) -> DataFrame:
    """Members (key, h, root) of buckets that hold more than one component, and how many these have."""
    rows = stage(spread_join(members, component.select(F.col("node").alias("h"), "root"), "h").withColumn("root", F.coalesce("root", "h")), "rooted")
    keys = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("size")).where("x <> y").select("key", "size")
    return spread_join(rows, stage(keys, "mixed-keys"), "key", "inner")


def _tiles(mixed: DataFrame, sets: DataFrame, rule: Rule, nearest: bool) -> DataFrame:
    """Pairs (a, b) of different components in the given buckets whose sizes and sketches allow a link.

    A bucket's members are dealt over tiles of about TILE; each two tiles meet
    in one group. nearest: only the pair of least distance of each two components.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            tile = now.column(0).to_numpy()
            cuts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield _near(now.slice(x, y - x), rule, nearest)
            rest = now.slice(int(cuts[-1]))
        if rest is not None and rest.num_rows:
            yield _near(rest, rule, nearest)

    rows = spread_join(mixed, sets.select("h", "n", "sketch"), "h", "inner", SKETCHES).withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("h"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"), (F.col("mine") >= F.col("other")).alias("up"), (F.col("mine") <= F.col("other")).alias("down"), "h", "root", "n", "sketch")
    found = rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long, r_a long, r_b long, far int")
    if nearest:
        return found.groupBy("r_a", "r_b").agg(F.min(F.struct("far", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
    return found.select("a", "b").distinct()


def _near(group: pa.Table, rule: Rule, nearest: bool) -> pa.RecordBatch:
    up, down, h, root, n = (group.column(i).to_numpy() for i in range(1, 6))
    raw = group.column(6).to_pylist()
    length = np.array([len(x) for x in raw], np.int64)
    out = []
    sizes = np.unique(length).tolist()
    full = {z: np.frombuffer(b"".join(raw[i] for i in np.flatnonzero(length == z)), np.uint8).reshape(-1, z) for z in sizes}
    for z in sizes:
        # sketches of z bytes or more, folded to z bytes; each pair is met at its shorter one
        bits = {w: fold(full[w], z) for w in sizes[sizes.index(z) :]}
        left = np.flatnonzero(length == z)
        for w, packed in bits.items():
            right = np.flatnonzero(length == w)
            for at in range(0, len(left), 64):
                i = left[at : at + 64]
                far = np.bitwise_count(bits[z][at : at + 64, None, :] ^ packed[None, :, :]).sum(axis=2, dtype=np.int32)
                a, b = n[i][:, None], n[right][None, :]
                good = (far <= (a + b) * (rule.q - rule.p) // (rule.q + rule.p)) & (rule.p * np.maximum(a, b) <= rule.q * np.minimum(a, b))
                good &= root[i][:, None] != root[right][None, :]
                good &= (up[i][:, None] & down[right][None, :]) | (down[i][:, None] & up[right][None, :])
                x, y = np.nonzero(good)
                out.append((i[x], right[y], far[x, y]))
    i, j, far = (np.concatenate(x) for x in zip(*out, strict=True))
    swap = h[i] < h[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
    order = np.lexsort((far, high, low)) if nearest else np.lexsort((h[j], h[i]))
    i, j, far, low, high = (x[order] for x in (i, j, far, low, high))
    one, two = (low, high) if nearest else (h[i], h[j])
    new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)]
    return pa.RecordBatch.from_arrays([pa.array(h[i][new]), pa.array(h[j][new]), pa.array(low[new]), pa.array(high[new]), pa.array(far[new], pa.int32())], names=["a", "b", "r_a", "r_b", "far"])


def jaccard_groups(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id of documents linked by a shingle similarity of p / q or more.

    Words are runs of characters other than ASCII white space, A-Z lower-cased.
    A text with fewer than k words is one shingle; null, empty or blank texts
    have none, link with nothing and are their own component. component_id is
    the smallest doc_id reachable by links. Repeated rows come out repeatedly;
    rows that share a doc_id but not a text stand each for itself. A null doc_id
    links with nothing and has a null component. An empty table gives no rows;
    other columns are ignored.
    """
    rule = Rule(k, p, q, hash_bits)
    described, sets = _classes(docs, rule)
    found = stage(_candidates(_bucket_rows(docs.where("doc_id is not null"), rule)), "candidates")
    pairs = stage(found.where("kind > 2").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("kind").alias("kind")), "pairs")
    members = stage(found.where("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("h")).distinct(), "members")

    def joined(some: DataFrame, component: DataFrame | None) -> DataFrame:
        links = stage(_verified(_near_in_sketch(some, sets, rule), sets, docs, rule), "links")
        known = links if component is None else links.unionByName(component.select(F.col("node").alias("a"), F.col("root").alias("b")))
        return stage(connected(known), "components")

    # the pair of each set that shares most blocks settles most groups
    component = joined(pairs.where("kind = 3").groupBy("a").agg(F.max(F.struct("shared", "b")).alias("x")).select("a", F.col("x.b").alias("b")), None)
    component = joined(_apart(pairs, component), component)
    for nearest in (True, False):
        mixed = stage(_mixed(members, component), "mixed")
        component = joined(stage(_tiles(mixed, sets, rule, nearest), "near"), component)
    # the least doc_id of each class's component, by the class; classes without links are their own
    rooted = stage(spread_join(sets.select("h", "doc_id"), component.select(F.col("node").alias("h"), "root"), "h"), "rooted-classes")
    least = stage(rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    named = stage(spread_join(rooted, least, "root").select("h", F.coalesce("least", "doc_id").alias("least")), "named-classes")
    out = spread_join(described.select("doc_id", "n", "h"), named, "h")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))).alias("component_id"))


def _classes(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """describe(), and the different sets (h, doc_id: the least that has it, n, sketch). Different sets never share h: rule.clash is filled."""
    described = stage(describe(docs, rule), "sets")
    while True:
        full = described.where("n > 0 and doc_id is not null")
        one = full.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), (F.min(F.struct("n", "h2")) != F.max(F.struct("n", "h2"))).alias("shared"))
        sets = stage(one, "classes")
        # of 64-bit hashes of N different sets some N * N / 2 ** 65 are shared: three of 10 ** 10
        clash = [r.h for r in sets.where("shared").select("h").toLocalIterator()]
        if not clash:
            # sketches are by far the widest rows: each join with them moves its pairs only
            sets = sets.drop("shared")
            return described, stage_by(sets, "h", "classes-by-hash") if sets.count() > SKETCHES else sets
        if len(rule.clash):
            raise RuntimeError("sets share both hashes")
        rule.clash = np.array(clash, np.int64)
        described = stage(describe(docs, rule), "sets")


def keep_one_of_each(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of its group; of rows with one doc_id one stays, that of the least text.

    Rows without a doc_id stay.
    """
    groups = stage(jaccard_groups(docs, k, p, q), "groups")
    ids = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    ids = stage(ids, "kept")
    named = docs.join(checked_broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    twice = ids.where("n > 1").select("doc_id")
    if twice.limit(1).count():
        repeated = named.join(checked_broadcast(twice), "doc_id", "left_semi")
        one = repeated.groupBy("doc_id").agg(F.min(F.struct(F.col("text").alias("__first"), *[F.col(c) for c in docs.columns])).alias("x")).select("x.*").select(*docs.columns)
        named = named.join(checked_broadcast(twice), "doc_id", "left_anti").unionByName(one)
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), 4, 85, 100)


OP6_SQL = r"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents where doc_id is not null
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s
  from words
), grams as (select doc_id, len(s) as n, unnest(s) as g from sets),
pairs as (
  select a.doc_id as x, b.doc_id as y, any_value(a.n) as n, any_value(b.n) as m, count(*) as c
  from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id and a.n * 100 >= b.n * 85 and b.n * 100 >= a.n * 85
  group by all
), links as (select x, y from pairs where 100 * c >= 85 * (n + m - c)),
both_ways as (select x, y from links union select y, x from links),
reach as (
  with recursive r(x, y) as (select doc_id, doc_id from sets union select r.x, b.y from r join both_ways b on r.y = b.x)
  select x, min(y) as component_id from r group by x
)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id from sets join reach on x = doc_id
"""
QUERIES = {"op6_jaccard_join": op6_jaccard_join}
SQL = {"op6_jaccard_join": OP6_SQL}
