"""Token ids as Parquet list columns: written in document order, read back selectively.

Files hold doc_id, part, start_in_part, n_tokens and ids. Ids are dictionary
encoded (a vocabulary's values repeat) or delta encoded, row groups and pages
have set sizes, and the page index that the Parquet writer adds lets a reader
skip to a doc_id; a read of lengths or offsets never touches the id pages.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import string_blocks, table, worker_tables
from loomwright.llm.pieces import LETTER, ChunkMemo
from loomwright.sources.shared import new_path


@dataclass(frozen=True)
class FileFormat:
    """encoding: "dictionary" or "delta"; sizes in bytes."""

    encoding: str = "dictionary"
    row_group_bytes: int = 32 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 2_000
    compression: str = "zstd"

    def options(self) -> dict[str, str]:
        out = {"compression": self.compression, "parquet.block.size": str(self.row_group_bytes), "parquet.page.size": str(self.page_bytes), "parquet.page.row.count.limit": str(self.page_rows)}
        if self.encoding == "delta":
            out |= {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}
        else:
            out |= {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)}
        return out


class LibraryEncoder:
    """The tokenizers library behind a chunk memo; missing chunks of a block go to it as one text.

    The ids are those of encode() of the whole text, as the library comes:
    texts with a control string are encoded whole, so that it gets its id.
    Elsewhere chunks are encoded with encode_special_tokens, as two chunks put
    end to end may look like a control string that no text has.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        controls = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        alphabet = _byte_alphabet()
        vocabulary = self.library.get_vocab()
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.length[i] = len(token) if all(c in alphabet for c in token) else len(token.encode())
        self.memo = ChunkMemo(self._chunks, self._whole, controls=re.compile(b"|".join(map(re.escape, controls))) if controls else None)

    def _text(self, text: str) -> np.ndarray:
        """The ids of encode(), control strings spelled out, without the character offsets that it works out too."""
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _whole(self, text: str) -> np.ndarray:
        self.library.encode_special_tokens = False
        try:
            return self._text(text)
        finally:
            self.library.encode_special_tokens = True

    def _chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that begin with no letter and end with one are encoded end to end: the cuts are match boundaries."""
        size = np.array([len(c) for c in chunks], np.int64)
        edges = np.frombuffer(b"".join(c[:1] + c[-1:] for c in chunks), np.uint8).reshape(-1, 2)
        fit = ~LETTER[edges[:, 0]] & LETTER[edges[:, 1]]
        joined, alone = np.flatnonzero(fit), np.flatnonzero(~fit)
        ids, counts = [], []
        for a in range(0, len(joined), 2_000):
            some = joined[a : a + 2_000]
            ids.append(self._text(b"".join(chunks[k] for k in some).decode()))
            ends = np.searchsorted(np.cumsum(self.length[ids[-1]]), np.cumsum(size[some])) + 1
            counts.append(np.diff(ends, prepend=0))
        for found in self.library.encode_batch_fast([chunks[k].decode() for k in alone], add_special_tokens=False) if len(alone) else []:
            ids.append(np.array(found.ids, np.int32))
            counts.append(np.array([len(ids[-1])]))
        count, flat = np.concatenate(counts), np.concatenate(ids)
        start = np.cumsum(count) - count
        back = np.argsort(np.concatenate([joined, alone]))
        count, start = count[back], start[back]
        return flat[np.arange(len(flat)) + np.repeat(start - np.cumsum(count) + count, count)], count


def _byte_alphabet() -> set[str]:
    """The characters that stand for single bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b) for b in shown} | {chr(256 + k) for k in range(256 - len(shown))}


def _encoder(path: str) -> LibraryEncoder:
    return worker_tables(("library", path), lambda: LibraryEncoder(path))


SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 2, file_format: FileFormat | None = None, parts: int | None = None) -> None:
    """Encode docs(doc_id, text) and write them to path in ascending doc_id order.

    Texts, smaller than their ids, are dealt out by ranges of doc_id; each task
    sorts its range and encodes it in order, so a running offset needs no
    shuffle of its own. part numbers the ranges in order.

    Null text: empty, only the end id. Null doc_ids come first; rows of one
    doc_id are ordered by text; repeated rows are repeated documents. No rows:
    no rows in the files. Other columns are ignored.
    """
    spark = docs.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tail = np.array([] if end_id is None else [end_id], np.int32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part, start = _encoder(tokenizer).memo, TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, end, data, offsets in string_blocks(batch.column(1)):
                ids, counts = memo.encode(data, offsets)
                ends = np.cumsum(counts)
                ids = np.insert(ids, np.repeat(ends, len(tail)), np.tile(tail, len(ends)))
                counts = counts + len(tail)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids, pa.int32()))
                rows = end - first
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows).cast(pa.int64()), pa.array(np.full(rows, part, np.int32)), pa.array(start + ends - counts), pa.array(counts), lists], names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])
                start += int(ends[-1])

    sorted_docs = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    sorted_docs.mapInArrow(run, SCHEMA).write.options(**(file_format or FileFormat()).options()).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids. Columns that aren't selected are not read; a filter on doc_id skips row groups and pages."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    # one row per range, as many as files: their offsets are a sum over that few rows
    ends = rows.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("total"))
    base = ends.groupBy().agg(F.sort_array(F.collect_list(F.struct("part", "total"))).alias("all"))
    base = base.select(F.expr("inline(transform(all, (x, i) -> named_struct('part', x.part, 'base', aggregate(slice(all, 1, i), 0L, (s, y) -> s + y.total))))"))
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def id_checksums(tokens: DataFrame) -> DataFrame:
    """tokens with ids replaced by ids_crc32, over little-endian unsigned 32-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            at = lists.offsets.to_numpy()
            sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return id_checksums(read_token_files(spark, path))


QUERIES = {"op8_token_files": op8_token_files}
SQL: dict[str, str] = {}
