"""Byte-level BPE: encoding by a lazily determinised finite-state transducer, streaming decode.

A token sequence is the BPE result of its bytes exactly if every token is its
own BPE result and so is every adjacent pair. That makes the segmentations a
regular language: a nondeterministic transducer reads bytes down the token
trie and may close a token wherever the pair with the token before is stable.
Its subset construction is made only for the states that texts reach. A prefix
has one BPE result, so where it can be closed its last token is certain; a
state holds only (token before, trie node) of each open thread, and each step
gives out the token that ends there, if any. Those tokens are back-pointers:
what the chains of all open threads agree on is emitted, so output lags by a
bounded lookahead (no thread is longer than the longest token). States are
kept in two generations of bounded size; dropping the older costs time only.

Whole blocks of texts are cut into chunks whose ids a memo keeps, so only
chunks not seen before reach the transducer.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomwright.llm.common import release, string_blocks, table, worker_tables
from loomwright.llm.pieces import ChunkMemo

#: One match of the split pattern whatever stands around it: a space at most, then letters.
_ONE = re.compile(rb" ?[A-Za-z]+")
#: Bytes between two looks at what all threads agree on.
_LAG = 128


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    """Merge ranks compiled to a transducer from the bytes of one piece to token ids."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 100_000, max_stable: int = 250_000):
        self.ranks, self.max_states, self.max_stable = ranks, max_states, max_stable
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.token_at: list[int] = [-1]
        self.depth: list[int] = [0]
        for token, i in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                down = self.child.get(key)
                if down is None:
                    down = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = down
            self.token_at[node] = i
        self.inner = bytearray(len(self.token_at))  # nodes with children
        for key in self.child:
            self.inner[key >> 8] = 1
        self.length = [0] * (max(self.bytes_of, default=0) + 1)
        for i, token in self.bytes_of.items():
            self.length[i] = len(token)
        self.stable_memo: dict[int, bool] = {}  # before << 32 | token
        self.reach_memo: dict[int, bool | None] = {}  # None: reached, but not through parts of lower rank
        self.spines: dict[int, list[tuple[bytes, int, int]]] = {}
        self.step: dict[int, int] = {}
        self.threads: list[tuple[int, ...]] = []  # of (token before + 1) << 32 | trie node
        self._generation()

    def _generation(self) -> None:
        """The states so far become the older generation; a new one begins with the start state."""
        self.older = (self.ids, self.step, self.threads) if self.threads else ({}, {}, [])
        start = (0,)
        self.ids, self.threads, self.step = {start: 0}, [start], {}

    def merged(self, piece: bytes, stop: int = 1) -> list[bytes]:
        """The merges applied one by one, lowest rank and leftmost first (the definition), until `stop` parts are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """The parts that stand at one end of a token while it is merged: (bytes, own rank, rank that consumes it), last first."""
        key = token << 1 | side
        known = self.spines.get(key)
        if known is None:
            known, whole, until = [], self.bytes_of[token], 1 << 60
            while True:
                own = self.ranks[whole] if len(whole) > 1 else -1
                known.append((whole, own, until))
                if len(whole) == 1:
                    break
                until, whole = own, self.halves(whole)[side]
            if len(self.spines) > 30_000:
                self.spines.clear()
            self.spines[key] = known
        return known

    def halves(self, token: bytes) -> tuple[bytes, bytes]:
        """What the last merge of a token joins."""
        parts = self.merged(token, stop=2)
        return parts[0], parts[1]

    def reached(self, token: int) -> bool:
        """Whether the merges turn the token's bytes into the token, through parts of lower rank."""
        known = self.reach_memo.get(token)
        if known is None:
            whole = self.bytes_of[token]
            known = self.merged(whole) == [whole]
            if known and len(whole) > 1:
                known = all(len(x) == 1 or self.ranks[x] < token and self.reached(self.ranks[x]) for x in self.halves(whole)) or None
            self.reach_memo[token] = known
        return known is not False

    def stable(self, before: int, token: int) -> bool:
        """Whether the bytes of the two tokens merge to the two.

        At any time one part ends the left token and one begins the right one.
        The pair breaks if two parts that stand at the same time can be merged
        before either is consumed (at equal rank the merge more to the left
        goes first).
        """
        key = before << 32 | token
        known = self.stable_memo.get(key)
        if known is None:
            if self.reach_memo.get(before) is None or self.reach_memo.get(token) is None:  # ranks out of order: by definition
                left, right = self.bytes_of[before], self.bytes_of[token]
                known = self.merged(left + right) == [left, right]
            else:
                known = self._unbroken(self._spine(before, 1), self._spine(token, 0))
            if len(self.stable_memo) > self.max_stable:
                self.stable_memo.clear()
            self.stable_memo[key] = known
        return known

    def _unbroken(self, lefts, rights) -> bool:
        i = j = 0
        rank = self.ranks.get
        while True:
            left, left_from, left_until = lefts[i]
            right, right_from, right_until = rights[j]
            crossing = rank(left + right)
            if crossing is not None and crossing < left_until and crossing <= right_until:
                return False
            # back to the time when the younger of the two was formed
            if left_from >= right_from:
                if left_from < 0:
                    return True
                i += 1
            else:
                j += 1

    def _expand(self, state: int, byte: int) -> int:
        """One step of the subset construction: next state << 32 | token that ends here + 1."""
        threads = self.threads[state]
        ids, step, held = self.older
        known = step.get(ids[threads] << 8 | byte) if threads in ids else None
        if known is not None:
            key, closed = held[known >> 32], (known & 0xFFFFFFFF) - 1
        else:
            key, closed = self._advance(threads, byte)
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.threads)
            self.threads.append(key)
        out = self.step[state << 8 | byte] = to << 32 | closed + 1
        return out

    def _advance(self, threads: tuple[int, ...], byte: int) -> tuple[tuple[int, ...], int]:
        found, closed = [], -1
        child, token_at, inner, reach, known = self.child.get, self.token_at, self.inner, self.reach_memo.get, self.stable_memo.get
        for thread in threads:
            down = child((thread & 0xFFFFFFFF) << 8 | byte)
            if down is None:
                continue
            before = (thread >> 32) - 1
            if inner[down]:
                found.append(before + 1 << 32 | down)
            token = token_at[down]
            if token >= 0 and closed < 0 and (reach(token) or self.reached(token)):
                fits = before < 0 or known(before << 32 | token)
                if fits is None:
                    fits = self.stable(before, token)
                if fits:
                    closed = token
        if closed >= 0:
            found.append(closed + 1 << 32)
        return tuple(found), closed

    def encode(self, piece: bytes) -> list[int]:
        if len(self.threads) > self.max_states:
            self._generation()
        whole = self.ranks.get(piece)
        if whole is not None and not self.reached(whole):
            return [whole]  # a token that merges don't reach stands only for a whole piece
        if len(piece) <= _LAG:
            return self._chain(self._run(0, piece)[1], len(piece))
        state, ends, out = 0, [], []
        for at in range(0, len(piece), _LAG):
            state, more = self._run(state, piece[at : at + _LAG])
            ends += more
            sure = self._agreed(state, ends)
            out += self._chain(ends, sure)
            del ends[:sure]
        return out + self._chain(ends, len(ends))

    def _run(self, state: int, piece: bytes) -> tuple[int, list[int]]:
        """The state after a piece, and the steps' outputs (in their lower bits)."""
        step, steps = self.step, []
        for byte in piece:
            try:
                to = step[state << 8 | byte]
            except KeyError:
                to = self._expand(state, byte)
            steps.append(to)
            state = to >> 32
        return state, steps

    def _chain(self, ends: list[int], at: int) -> list[int]:
        """The tokens that lead to position `at`."""
        out, length = [], self.length
        while at:
            token = (ends[at - 1] & 0xFFFFFFFF) - 1
            out.append(token)
            at -= length[token]
        out.reverse()
        return out

    def _agreed(self, state: int, ends: list[int]) -> int:
        """The last position that the chains of all open threads go through."""
        common: set[int] | None = None
        for thread in self.threads[state]:
            at = len(ends) - self.depth[thread & 0xFFFFFFFF]
            way = {at}
            while at:
                at -= self.length[(ends[at - 1] & 0xFFFFFFFF) - 1]
                way.add(at)
            common = way if common is None else common & way
        return max(common) if common else 0


#: The UTF-8 state machine: state after a byte, from (state, class of byte). State 0: between characters; 1-3: that many
#: continuation bytes to come; 4-7: after E0, ED, F0, F4, whose next byte has a narrower range.
_ERROR = -1


def utf8_step(state: int, byte: int) -> int:
    if state == 0:
        if byte < 0x80:
            return 0
        if 0xC2 <= byte <= 0xDF:
            return 1
        if byte == 0xE0:
            return 4
        if byte == 0xED:
            return 5
        if 0xE1 <= byte <= 0xEF:
            return 2
        if byte == 0xF0:
            return 6
        if byte == 0xF4:
            return 7
        return 3 if 0xF1 <= byte <= 0xF3 else _ERROR
    low, high, to = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}[state]
    return to if low <= byte <= high else _ERROR


class StreamDecoder:
    """Token ids in, text out as soon as its characters are complete; feed() may be called with any split of the ids.

    Malformed bytes come out as U+FFFD, as bytes.decode(errors="replace") has
    them. Only the last character can be open: the machine runs from the last
    lead byte, at most three bytes back, and what it leaves open is held.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.pending = vocabulary, b""

    def feed(self, ids: np.ndarray) -> str:
        return self.feed_bytes(self.vocabulary.join(ids))

    def feed_bytes(self, raw: bytes) -> str:
        data = self.pending + raw
        hold = len(data)
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] >= 0xC0:
                state = 0
                for byte in data[-back:]:
                    state = utf8_step(state, byte) if state != _ERROR else state
                if state > 0:
                    hold = len(data) - back
                break
        self.pending = data[hold:]
        return data[:hold].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.pending = self.pending.decode("utf-8", "replace"), b""
        return out


class Vocabulary:
    """Bytes of each id, for decoding many ids at once."""

    def __init__(self, bytes_of: dict[int, bytes]):
        size = max(bytes_of) + 1
        tokens = [bytes_of.get(i, b"") for i in range(size)]
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        ends = np.cumsum(length)
        if not len(ids):
            return b""
        where = np.arange(ends[-1]) + np.repeat(self.start[ids] - ends + length, length)
        return self.blob[where].tobytes()


@dataclass(frozen=True)
class EncoderTables:
    """Sizes of a worker's tables, about 230 MB by default; smaller ones take more time and give the same ids."""

    states: int = 100_000
    stable: int = 250_000
    memo_slots: int = 1 << 19
    memo_ids: int = 1 << 22


#: About 150 MB, for executors whose memory other stages have filled.
SMALL_TABLES = EncoderTables(30_000, 120_000, 1 << 18, 1 << 21)


class Encoder:
    """Whole texts to ids: the split pattern, then the transducer for each match."""

    def __init__(self, path: str, pattern: str, tables: EncoderTables = EncoderTables()):
        import regex

        self.pattern = regex.compile(pattern)
        self.transducer = Transducer(load_ranks(path), tables.states, tables.stable)
        self.vocabulary = Vocabulary(self.transducer.bytes_of)
        self.memo = ChunkMemo(self._chunks, self._text, slots=tables.memo_slots, pool=tables.memo_ids)

    def _chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        encode, findall, one = self.transducer.encode, self.pattern.findall, _ONE.fullmatch
        flat: list[int] = []
        counts = []
        for chunk in chunks:
            before = len(flat)
            if one(chunk):
                flat += encode(chunk)
            else:
                for piece in findall(chunk.decode("utf-8", "replace")):
                    flat += encode(piece.encode("utf-8"))
            counts.append(len(flat) - before)
        return np.array(flat, np.int32), np.array(counts, np.int64)

    def _text(self, text: str) -> np.ndarray:
        """A text that holds characters for which the chunks are not known to be safe: the pattern over all of it."""
        flat: list[int] = []
        known: dict[str, list[int]] = {}
        for piece in self.pattern.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.transducer.encode(piece.encode("utf-8"))
                if len(known) < 100_000:
                    known[piece] = ids
            flat += ids
        return np.array(flat, np.int32)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        return self.memo.encode(raw, np.array([0, len(raw)]))[0].astype("<u4").tobytes()


def encoder(path: str, pattern: str, tables: EncoderTables = EncoderTables()) -> Encoder:
    """One per worker process; its memos are bounded, and go when another operator needs the worker."""

    def make() -> Encoder:
        made = Encoder(path, pattern, tables)
        gc.collect()
        gc.freeze()  # scanning its tables again and again costs more than the merges
        gc.set_threshold(200_000, 50, 100)
        return made

    return worker_tables(("bpe", path, pattern, tables), make)


def decode(vocabulary: Vocabulary, ids: np.ndarray, step: int = 1 << 16) -> Iterator[str]:
    """The text of the ids, in parts, as the streaming decoder gives it out."""
    stream = StreamDecoder(vocabulary)
    for i in range(0, len(ids), step):
        yield stream.feed(ids[i : i + step])
    yield stream.close()


def encode_texts(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", digests: bool = False, text_digest: bool = False, tables: EncoderTables = EncoderTables()) -> DataFrame:
    """One row per document: id, n_tokens, ids (array<int>) and the text decoded from them again.

    With digests: ids_sha256 and decoded_sha256 in place of the two, so that no
    ids leave the task that made them. With text_digest only the text is
    replaced by decoded_sha256.

    Null or empty text: no tokens. Long texts are encoded whole. Repeated rows
    give repeated results; other columns are ignored. No shuffle.
    """
    name = id_column
    hashed = digests or text_digest
    names = [name, "n_tokens", "ids_sha256" if digests else "ids", "decoded_sha256" if hashed else "decoded"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern, tables)
        for batch in batches:
            for a, b, data, offsets in string_blocks(batch.column(1)):  # results of a few texts at a time
                ids, counts = e.memo.encode(data, offsets)
                ends = np.cumsum(counts)
                decoded = []
                for x, y in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                    parts = decode(e.vocabulary, ids[x:y])
                    if hashed:
                        digest = hashlib.sha256()
                        for part in parts:
                            digest.update(part.encode("utf-8"))
                        decoded.append(digest.hexdigest())
                    else:
                        decoded.append("".join(parts))
                if digests:
                    raw = memoryview(ids.astype("<u4")).cast("B")
                    lists = pa.array([hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip((ends - counts).tolist(), ends.tolist(), strict=True)], pa.string())
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), lists, pa.array(decoded, pa.string())], names=names)
        release()

    kind = dict(docs.dtypes)[id_column]
    tail = ("ids_sha256 string" if digests else "ids array<int>") + (", decoded_sha256 string" if hashed else ", decoded string")
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, {tail}")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


QUERIES = {"op10_bpe": op10_bpe}
SQL: dict[str, str] = {}
