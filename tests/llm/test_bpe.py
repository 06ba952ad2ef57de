import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from loomwright.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    e = bpe.encoder(PATH, P.PATTERN)
    return e, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.transducer.ranks, special_tokens={})


TEXTS = ["", " ", "don't you'll 'tis 'т", "a²3 ½x 12ab", "x  y\n\n z\t ", "日本語 テキスト 👩‍👩‍👧 नमस्ते", "<|endoftext|>", "a" * 5000, "\x1c\x1d a\x85b\xa0c", "Ünïcödé ñandú ÉCOLE", "!!?? -- ... ((", " x　y", "x�y\x00"]


def test_equals_library(both):
    e, library = both
    random.seed(3)
    texts = TEXTS + ["".join(random.choice("ab 'st.\n\té1²Ж\U0001f600-") for _ in range(random.randrange(60))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == library.encode_ordinary(text), repr(text)


def test_pairs_by_definition(both):
    t = both[0].transducer
    random.seed(5)
    for _ in range(5000):
        a, b = random.randrange(50256), random.randrange(3000)
        left, right = t.bytes_of[a], t.bytes_of[b]
        assert t.stable(a, b) == (t.merged(left + right) == [left, right])


def test_states_are_bounded():
    small = bpe.Transducer(bpe.load_ranks(PATH), max_states=50)
    for word in ("tionable", "heavenly", "thunderous", "x" * 300) * 3:
        assert b"".join(small.bytes_of[i] for i in small.encode(word.encode())) == word.encode()
    assert len(small.threads) < 50 + 301 and len(small.older[2]) < 50 + 301


def test_streaming_decode_any_split(both):
    e = both[0]
    random.seed(7)
    for text in TEXTS + ["é日👩" * 40]:
        ids = np.frombuffer(e.encode(text), "<u4")
        for _ in range(5):
            stream, at, out = bpe.StreamDecoder(e.vocabulary), 0, ""
            while at < len(ids):
                step = random.randrange(1, 4)
                out += stream.feed(ids[at : at + step])
                at += step
            assert out + stream.close() == text


def test_streaming_decode_malformed(both):
    e = both[0]
    one = {t: i for i, t in e.transducer.bytes_of.items() if len(t) == 1}
    random.seed(11)
    for _ in range(3000):
        raw = bytes(random.choice([0x41, 0x80, 0xBF, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0xED, 0xA0, 0xF4, 0x90, 0xFF]) for _ in range(random.randrange(8)))
        ids = np.array([one[bytes([b])] for b in raw], np.int64)
        stream = bpe.StreamDecoder(e.vocabulary)
        cut = random.randrange(len(raw) + 1)
        assert stream.feed(ids[:cut]) + stream.feed(ids[cut:]) + stream.close() == raw.decode("utf-8", "replace"), raw


def test_query_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the cat", "x"), (3, "the cat", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(bpe.encode_texts(docs, PATH, P.PATTERN, digests=True).collect())
    assert [r.n_tokens for r in got] == [0, 0, 2, 2]
    assert got[2].decoded_sha256 == hashlib.sha256(b"the cat").hexdigest() and got[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    full = bpe.encode_texts(docs, PATH, P.PATTERN).where("doc_id = 3").first()
    assert full.decoded == "the cat" and len(full.ids) == 2
    assert bpe.encode_texts(docs.limit(0), PATH, P.PATTERN).count() == 0


def thue_morse(n, a, b):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_built_to_collide(both, size):
    e, library = both
    texts = [thue_morse(size, "a", "b"), thue_morse(size, "b", "a"), "x " + thue_morse(size, "a", "b"), "x " + thue_morse(size, "b", "a")]
    for text in texts * 2:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_blocks_equal_library(both):
    """Many texts of one block: cuts at texts' edges, spaces, signs and newlines."""
    e, library = both
    random.seed(12)
    for _ in range(300):
        texts = ["".join(random.choice(["the", "A", " ", "  ", "\n", "\n\n", "'s", "'", ",", ".", "12", "\t", "é", "Öl", "###", " '", "\r\n"]) for _ in range(random.randrange(12))) for _ in range(30)]
        raw = [t.encode() for t in texts]
        ids, counts = e.memo.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        ends = np.cumsum(counts)
        for t, a, b in zip(texts, ends - counts, ends, strict=True):
            assert ids[a:b].tolist() == library.encode_ordinary(t), repr(t)


def test_bounded_lookahead(both):
    e, library = both
    random.seed(13)
    for text in ("a" * 3000, "ab" * 2000, "".join(random.choice("etaoinshr") for _ in range(4000)), "th" * 700 + "e" * 700):
        assert e.transducer.encode(text.encode()) == library.encode_ordinary(text)


def test_query(spark):
    """The registered query's rows against the library, over all documents of the smallest table."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    with open(PATH, "rb") as f:
        ranks = bpe.load_ranks(f.name)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.op10_bpe(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = np.array(library.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
