"""Shared helpers: the checkpoint folder, size-checked joins and vectorised text arrays.

Text is handled in blocks: the UTF-8 buffer of an Arrow string column is seen
as one numpy byte array with document offsets, so tokenising and hashing run
over many documents per numpy call and never over a prefix of any text.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.sources.shared import new_path

#: Rows of a one- or two-column long table that may be broadcast (about 16 MB); larger sides are shuffled.
BROADCAST_ROWS = 400_000
#: Rows that a bucket of a table in buckets holds about.
BUCKET_ROWS = 200_000
#: Bytes of text that one numpy block holds (a longer document is a block of its own).
BLOCK_BYTES = 1 << 20
#: Bytes of one Arrow batch; Spark's default is larger than a worker should hold of long texts.
ARROW_BYTES = 4 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


# ---------------------------------------------------------------- Spark side


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it again.

    Later reads survive lost executors and don't run the lineage once more.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, key: str, what: str) -> DataFrame:
    """Like stage(), as a table in buckets of key: joins on it shuffle the other side alone, however often they come. df should be a staged table."""
    spark = df.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // BUCKET_ROWS + 1)
    path = new_path(spark, what)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return spark.table(name)


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows (counted on the executors), else as it is; df should be a staged table."""
    return F.broadcast(df) if df.count() <= limit else df


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", limit: int = 100_000, hot_rows: int = 1_000, hot_keys: int = 10_000, counted: DataFrame | None = None) -> DataFrame:
    """left joined with right, which holds each key once; how: "left" or "inner". Both should be staged tables; of a left that isn't, counted is a staged table with the same keys as often.

    A right side of at most limit rows is broadcast. Beyond that, the keys that
    most rows of left have (hot_rows at least) meet their rows of right by a
    broadcast of at most hot_keys rows, and only the others are shuffled, so
    that no task gets all rows of a frequent key.
    """
    if right.count() <= limit:
        return left.join(F.broadcast(right), key, how)
    many = (left if counted is None else counted).where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= hot_rows)
    hot = stage(many.orderBy(F.desc("__n"), key).limit(hot_keys).select(key), "hot-keys")
    if not hot.count():
        return left.join(right, key, how)
    few = stage(right.join(F.broadcast(hot), key, "left_semi"), "hot-rows")
    own = left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, how)
    return own.unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, how))


def crc_mod3(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows with remainder 1 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


# ---------------------------------------------------------------- Python side


_tables: list[tuple[object, object]] = []


def worker_tables(owner: object, make: Callable[[], object]) -> object:
    """The tables that a worker process keeps between tasks: those of one owner, made at its first use; they replace another owner's."""
    if not _tables or _tables[0][0] != owner:
        drop_tables()
        _tables.append((owner, make()))
    release()
    return _tables[0][1]


def drop_tables() -> None:
    """Called by operators that keep no tables: what an earlier stage kept in this worker goes."""
    if _tables:
        _tables.clear()
        gc.unfreeze()
    gc.collect()
    release()


def release() -> None:
    """Give freed memory back to the system: a worker is used again by later stages, whose needs differ."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def string_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES):
    """Yield (first row, end row, byte array, offsets from 0) over a string column; null is empty."""
    column = column.fill_null("")
    if pa.types.is_large_string(column.type) or not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + block_bytes, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
    release()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Spans of more bytes are digested one by one.
_LONG = 256


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of symbols[start:end] for each span; equal spans have equal hashes anywhere. Each seed gives a hash of its own.

    Eight bytes at a time go through a mixing step that isn't linear, so no
    word is built to collide by its form; long spans go through BLAKE2.
    """
    raw = np.ascontiguousarray(symbols)
    starts, size = starts * raw.itemsize, (ends - starts) * raw.itemsize
    padded = np.concatenate([raw.view(np.uint8), np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    out = mix((size + 1).astype(np.uint64) * _STEP + np.uint64(seed * 0xD1342543DE82EF95 % (1 << 64)))
    use = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left = starts[use], size[use]
    while len(use):
        out[use] = mix((out[use] + _STEP) ^ (eights[at] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        use, at, left = use[more], at[more] + 8, left[more] - 8
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : starts[i] + size[i]], digest_size=8, key=key).digest(), "little")
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at document offsets."""
    n = len(inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


#: ASCII white space of the near-duplicate contract: space, and tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ascii_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased: their hashes, and each document's first word (n + 1 entries)."""
    starts, ends = runs(~_SPACE[data], offsets)
    return span_hashes(_LOWER[data], starts, ends), np.searchsorted(starts, offsets)


_letters: list[np.ndarray] = []


def folded_letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, digit or mark; its simple lower case."""
    if not _letters:
        chars = np.arange(0x110000, dtype=np.uint32)
        word = np.zeros(0x110000, bool)
        lower = chars.copy()
        for i in range(0x110000):
            if 0xD800 <= i < 0xE000:
                continue
            c = chr(i)
            if c.isalnum():
                word[i] = True
                if len(low := c.lower()) == 1:
                    lower[i] = ord(low)
        for a, b in ((0x300, 0x370), (0x900, 0xE00), (0x1AB0, 0x1B00), (0x20D0, 0x2100)):  # combining marks stay inside words
            word[a:b] = True
        _letters.extend((word, lower))
    return _letters[0], _letters[1]


def codepoints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) of a UTF-8 block, and the document offsets among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) == len(data):
        return points, offsets
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=seen[1:])
    return points, seen[offsets]


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Case-folded runs of letters and digits: their hashes, and each document's first word (n + 1 entries)."""
    points, at = codepoints(data, offsets)
    word, lower = folded_letters()
    starts, ends = runs(word[points], at)
    return span_hashes(lower[points], starts, ends), np.searchsorted(starts, at)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (none if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    step = 0xD6E8FEB86659FD93
    for i in range(k):
        out += words[i : i + n] * np.uint64(pow(step, i + 1, 1 << 64) | 1)
    return mix(out)
