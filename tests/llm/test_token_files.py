import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import public_tokenizers as P
from tokenizers import Tokenizer

from loomwright.llm import token_files as tf
from loomwright.llm.pieces import ChunkMemo

PATH = P.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "don't you'll  'tis\n\n", "a²3 ½x", "×a÷b", "日本語 テキスト", "<|endoftext|> x", "Ünïcödé ñandú", "!!?? --\t", "a b c " * 500, "x  y ", "ö Ö"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return t


def test_whole_table(spark, tmp_path, library):
    rows = [(k * 7 % 13, t, "x", 1.0) for k, t in enumerate(TEXTS)] + [(None, "null id", "x", 1.0), (3, "again", "x", 1.0), (3, "again", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, start double")
    for fmt in (tf.FileFormat(), tf.FileFormat(encoding="delta")):
        path = f"{tmp_path}/{fmt.encoding}"
        tf.write_token_files(docs, PATH, path, file_format=fmt, parts=3)
        got = tf.read_token_files(spark, path).collect()
        expected, start = [], 0
        for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
            expected.append((i, start, len(ids), ids))
            start += len(ids)
        assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
        sums = {r.start: r.ids_crc32 for r in tf.id_checksums(tf.read_token_files(spark, path)).collect()}
        assert all(sums[s] == zlib.crc32(np.array(ids, "<u4").tobytes()) for _, s, _, ids in expected)
        plan = tf.read_token_files(spark, path).select("doc_id", "n_tokens")._jdf.queryExecution().toString()
        assert "ids" not in plan.split("== Physical Plan ==")[1]
    one = next(p for p in (tmp_path / "dictionary").glob("*.parquet") if pq.ParquetFile(p).metadata.num_rows)
    column = pq.ParquetFile(one).metadata.row_group(0).column(4)
    assert "ids" in column.path_in_schema and column.has_offset_index and any("DICTIONARY" in e for e in column.encodings)


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tf.write_token_files(docs, PATH, f"{tmp_path}/none", parts=2)
    assert tf.read_token_files(spark, f"{tmp_path}/none").count() == 0


def test_memo_of_few_slots(library):
    e = tf.LibraryEncoder(PATH)
    memo = ChunkMemo(e._chunks, e._text, slots=8, pool=4096)
    random.seed(2)
    for _ in range(60):
        texts = ["".join(random.choice(["The", " cat", "'s", "\n", "  ", "é", "x1", "!", "²", "×", " ñu"]) for _ in range(random.randrange(12))) for _ in range(20)]
        raw = [t.encode() for t in texts]
        ids, counts = memo.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [library.encode(t, add_special_tokens=False).ids for t in texts]
