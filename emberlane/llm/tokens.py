"""Token ids of many texts by way of a table of pieces, for tokenizers that split at white space.

Texts are cut where the tokenizer cuts anyway: at ASCII white space, around ASCII digits, and between an
ASCII or Latin letter and ASCII punctuation other than the apostrophe. A piece's ids do not depend on
its neighbours, so each is encoded once and kept in an open-addressing table that is looked up for all
pieces of a batch at a time, by 63 bits of hash.

That holds for tokenizers that lower the case of ASCII letters and cut there. Whether one does is tried on texts that mix
all kinds of characters; one that doesn't encodes every text as it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from emberlane.llm.wordhash import SPACE, buffers, hash_spans

#: What a tokenizer must encode alike, in pieces and as a whole, to be given pieces.
PROBES = (
    "The quick BROWN fox, it's 12 o'clock; don't you'll? (yes) [no] {x}=3.14 a_b-c/d\\e @f #g $5% ^& *~`|<>\"q\"",
    "été Ärger ñandú ßx œuvre — “quoted” … 日本語テスト émigré's naïve 1st 2nd 3000km² x1y2z3 ABC123def",
    "tabs\tand\nnew\r\nlines  double   triple\x0bvertical a.b.c www.x-y.org/a?b=c&d=e user@host.com 12:30 -5 +7 1,000",
    "éa1é,b'c ''x'' 's 't're don''t ..'.. ,,, !!! ??? 1!2?3 a!b?c é!é?é İstanbul ΣΑΣ straße ﬁne Ⅳ ½",
    "",
)
_SLOTS = 1 << 21
_LIMIT = 1_000_000  # pieces kept; beyond it the table starts anew
_FLAT_LIMIT = 8_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Kinds of bytes: 0 white space, 1 letter, 2 punctuation, 3 digit, 4 anything that may belong to either side.
_KIND = np.full(256, 4, dtype=np.uint8)
_KIND[33:127] = 2
_KIND[39] = 4
_KIND[48:58] = 3
_KIND[65:91] = _KIND[97:123] = 1
_KIND[SPACE] = 0
_CUT = np.zeros((5, 5), dtype=bool)  # whether a piece ends between two kinds
_CUT[1, 2] = _CUT[2, 1] = True
_CUT[3, :] = _CUT[:, 3] = True


class PieceEncoder:
    """Ids of texts, as one array and the number of ids of each text."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.special = sorted(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.separator = self.special[0].decode() if self.special else None
        self.exact = True
        self._clear()
        self.exact = bool(self.separator) and all(np.array_equal(a, b) for a, b in zip(self.encode(pa.array(PROBES)), self._whole(list(PROBES))))

    def _clear(self) -> None:
        self.key = np.zeros(_SLOTS, dtype=np.uint64)
        self.at = np.zeros(_SLOTS, dtype=np.int32)
        self.size = np.zeros(_SLOTS, dtype=np.int32)
        self.flat = np.zeros(1 << 16, dtype="<u4")
        self.used = self.count = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = buffers(texts)
        raw = data.tobytes()
        if not self.exact or any(s in raw for s in self.special) or not self.separator:  # such a text is encoded as it is
            return self._whole([raw[s:e].decode() for s, e in zip(at[:-1].tolist(), at[1:].tolist())])
        data = _LOWER[data]
        start, end, first = pieces(data, at)
        h = hash_spans(data, start, end) | np.uint64(1)
        slot = self._find(h)
        missing = slot < 0
        if missing.any():
            if self.count > _LIMIT or self.used > _FLAT_LIMIT:
                self._clear()
                missing[:] = True
            new, where = np.unique(h[missing], return_index=True)
            where = np.flatnonzero(missing)[where]
            self._learn(new, [data[s:e].tobytes() for s, e in zip(start[where].tolist(), end[where].tolist())])
            slot = self._find(h)
        size, source = self.size[slot].astype(np.int64), self.at[slot].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(source - upto[:-1], size) + np.arange(upto[-1])]
        return ids, np.diff(upto[first])

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.array([len(x) for x in ids], dtype=np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each piece, -1 if it isn't known."""
        slot = (h >> np.uint64(40)).astype(np.int64) & (_SLOTS - 1)
        key = self.key[slot]
        out = np.where(key == h, slot, -1)
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            s = (slot[open_] + 1) & (_SLOTS - 1)
            slot[open_] = s
            key = self.key[s]
            hit = key == h[open_]
            out[open_[hit]] = s[hit]
            open_ = open_[~hit & (key != 0)]
        return out

    def _learn(self, h: np.ndarray, words: list[bytes]) -> None:
        mark = self.tokenizer.token_to_id(self.separator)
        ids, sizes = [], []
        for s in range(0, len(words), 2000):
            part = words[s : s + 2000]
            got = np.asarray(self.tokenizer.encode(self.separator.join([w.decode() for w in part]), add_special_tokens=False).ids, dtype="<u4")
            cut = np.flatnonzero(got == mark)
            sizes.append(np.diff(np.concatenate([[-1], cut, [len(got)]])) - 1)
            ids.append(np.delete(got, cut))
        size = np.concatenate(sizes)
        flat = np.concatenate(ids)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        at = self.used + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.used += len(flat)
        self.count += len(h)
        slot = (h >> np.uint64(40)).astype(np.int64) & (_SLOTS - 1)
        todo = np.arange(len(h))
        while len(todo):
            free = self.key[slot[todo]] == 0
            _, lead = np.unique(np.where(free, slot[todo], -1 - np.arange(len(todo))), return_index=True)
            lead = lead[free[lead]]
            placed = todo[lead]
            self.key[slot[placed]], self.at[slot[placed]], self.size[slot[placed]] = h[placed], at[placed], size[placed]
            rest = np.ones(len(todo), dtype=bool)
            rest[lead] = False
            todo = todo[rest]
            taken = self.key[slot[todo]] != 0
            slot[todo[taken]] = (slot[todo[taken]] + 1) & (_SLOTS - 1)


def pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each piece, and the first piece of each text (one more for the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    kind = _KIND[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9))
    lead = lead[(data[lead] != 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]  # Latin letters of two bytes
    kind[lead] = 1
    kind[lead + 1] = 1
    inside = kind > 0
    edge = _CUT[kind[:-1], kind[1:]]
    cut = at[1:-1]
    edge[cut[(cut > 0) & (cut < len(data))] - 1] = True
    left, right = inside.copy(), inside.copy()
    left[1:] &= ~inside[:-1] | edge
    right[:-1] &= ~inside[1:] | edge
    start, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    return start, end, np.searchsorted(start, at)
