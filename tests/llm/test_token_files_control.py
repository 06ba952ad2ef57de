import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from loomwright.llm import token_files as tf
from loomwright.llm.subwords import texts_block

TEXTS = ["", "don't  you'll\n\n", "Ünïcödé 日本語", "x < | endoftext | > y", "<|endoftex|>", "x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>", "日本 <|endoftext|>語", "plain words <|endof", "text|> more", "|<|endoftext|>|", "<|endoftext", "|>"]


@pytest.mark.parametrize("order", [1, -1])
def test_ids_equal_the_unchanged_library(order):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = TEXTS[::order] * 3
    ids, counts = tf.LibraryEncoder(path).memo.encode(*texts_block(texts))
    ends = counts.cumsum()
    assert [ids[b - n : b].tolist() for n, b in zip(counts, ends, strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in library.encode(TEXTS[5], add_special_tokens=False).ids
