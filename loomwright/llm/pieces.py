"""Tokenising blocks of text with a memo of chunks, many documents per numpy call.

A chunk is a run of non-letters and the letters after it, cut once more where
that is safe: before a space that a letter follows, and before letters after a
sign, a digit, or a newline with a sign, digit or letter in front. Between a
letter and a character that is none, and at those cuts, there is always a
match boundary of the byte-level split pattern, and what stands before it is
split alike without the rest, so chunks can be encoded one by one. A memo, looked up for a
whole block at once, keeps the ids of chunks already seen in a fixed number of
slots, each with the length and two independent hashes of its chunk, all of
which must agree; a chunk that was pushed out is encoded again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from loomwright.llm.common import span_hashes

# Letters: A-Z, a-z and U+00C0-U+023F but the signs U+00D7 and U+00F7; their UTF-8 bytes but ASCII are C3-C8 and continuation bytes.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
_OTHER = np.zeros(256, bool)
_OTHER[0xC0:0xC3] = _OTHER[0xC9:] = True

#: ASCII signs and digits but the apostrophe, which may begin a contraction.
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN &= ~LETTER
_SIGN[39] = False

Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


class ChunkMemo:
    """encode_chunks: UTF-8 chunks -> (all ids in order, number of ids of each); encode_text: ids of one text of any kind, also for texts that hold a control string."""

    def __init__(self, encode_chunks: Encode, encode_text: Callable[[str], np.ndarray], slots: int = 1 << 21, pool: int = 1 << 24, controls: re.Pattern[bytes] | None = None):
        self.controls = controls
        self.encode_chunks, self.encode_text = encode_chunks, encode_text
        self.mask, self.slots, self.size = np.uint64(slots - 1), slots, pool
        self._reset()

    def _reset(self) -> None:
        self.hash = np.zeros(self.slots, np.uint64)
        self.check = np.zeros(self.slots, np.uint64)
        self.size_of = np.zeros(self.slots, np.int32)
        self.where = np.zeros(self.slots, np.int32)
        self.count = np.zeros(self.slots, np.int32)
        self.pool = np.zeros(self.size, np.int32)
        self.used = 0

    def _add(self, ids: np.ndarray) -> int:
        at = self.used
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(len(ids), np.int32)])
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a block in order, and how many each has."""
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        odd = np.zeros(len(data) + 1, np.int64)
        strange = _OTHER[data]
        strange[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        np.cumsum(strange, out=odd[1:])
        # a lone C2 leads U+0080-U+00BF: spaces, signs and two letters
        alone = odd[offsets[1:]] > odd[offsets[:-1]]
        if self.controls:
            raw = data.tobytes()
            for m in self.controls.finditer(raw):
                # one that two texts make together is in neither
                i = int(np.searchsorted(offsets, m.start(), "right")) - 1
                alone[i] |= m.end() <= offsets[i + 1] or self.controls.search(raw[offsets[i] : offsets[i + 1]]) is not None
                k = int(np.searchsorted(offsets, m.end(), "left")) - 1
                alone[k] |= self.controls.search(raw[offsets[k] : offsets[k + 1]]) is not None
        other = np.flatnonzero(alone)
        if self.used + len(data) > self.size:
            self._reset()
        letter = LETTER[data]
        first = ~letter
        first[1:] &= letter[:-1]
        # a space between a character that is no letter and a letter of the same text
        inside = np.ones(len(data) + 1, bool)
        inside[offsets] = False  # False: a text begins here
        last = ~letter[:-2] & (data[1:-1] == 32) & letter[2:] & inside[2:-1]
        first[1:-1] |= last
        sign = _SIGN[data]
        first[1:] |= letter[1:] & sign[:-1]
        first[2:] |= letter[2:] & (data[1:-1] == 10) & (sign[:-2] | letter[:-2]) & inside[1:-2]
        first[0] = True
        first[offsets[:-1][sizes > 0]] = True
        starts = np.flatnonzero(first)
        doc = np.searchsorted(offsets[1:], starts, "right")
        if len(other):
            left_out = np.zeros(n, bool)
            left_out[other] = True
            keep = ~left_out[doc]
        ends = np.append(starts[1:], len(data))
        if len(other):
            starts, ends, doc = starts[keep], ends[keep], doc[keep]
        where, count = self._look_up(data, starts, ends)
        if len(other):
            extra = [self.encode_text(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")) for i in other]
            at = [self._add(ids) for ids in extra]
            doc = np.concatenate([doc, other])
            order = np.argsort(doc, kind="stable")
            doc = doc[order]
            where = np.concatenate([where, np.array(at, np.int32)])[order]
            count = np.concatenate([count, np.array([len(x) for x in extra], np.int32)])[order]
        ends = np.cumsum(count, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.arange(total) + np.repeat(where - ends + count, count)]
        bounds = np.concatenate([[0], ends])[np.searchsorted(doc, np.arange(n + 1))]
        return ids, np.diff(bounds)

    def _look_up(self, data, starts, ends):
        h, check, size = span_hashes(data, starts, ends), span_hashes(data, starts, ends, 1), (ends - starts).astype(np.int32)
        slot = (h & self.mask).astype(np.int64)
        where, count = self.where[slot], self.count[slot]
        missing = np.flatnonzero((self.hash[slot] != h) | (self.check[slot] != check) | (self.size_of[slot] != size))
        if len(missing):
            order = missing[np.lexsort((size[missing], check[missing], h[missing]))]
            a, b = order[1:], order[:-1]
            new = np.append(True, (h[a] != h[b]) | (check[a] != check[b]) | (size[a] != size[b]))
            one, which = order[new], np.cumsum(new) - 1
            raw = data.tobytes()
            ids, counts = self.encode_chunks([raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
            at = self._add(ids) + np.cumsum(counts) - counts
            where[order], count[order] = at[which], counts[which]
            # of chunks that share a slot one stays, with all its entries
            slot, last = np.unique(slot[one][::-1], return_index=True)
            last = len(one) - 1 - last
            self.hash[slot], self.check[slot], self.size_of[slot] = h[one[last]], check[one[last]], size[one[last]]
            self.where[slot], self.count[slot] = at[last], counts[last]
        return where, count
