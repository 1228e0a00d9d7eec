"""Byte-level BPE ids through the tokenizers library, with a store of units.

A text is cut at single spaces that stand between two plainly printable
characters, between a letter and a point or line feed, and after a line feed
that stands between such characters:
the pre-tokenizer always cuts there too (a space opens the next
piece), so the ids of the units, joined, are the ids of the text.  Units recur
far more often than texts, so each worker keeps the ids of those it has met, in
flat arrays behind a hash table, and looks up all units of a block at once.
What is found is compared with the text byte for byte, so equal hashes can't
give wrong ids.

A text that holds the string of an added token gets what the library's plain
call gives for it (the token's id); with special_ids=False such strings are
ordinary text.
"""

from __future__ import annotations

import functools
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from orbitalis.llm import textkernel as tk
from orbitalis.llm.textkernel import spans_of

#: Bounds of the store (speed and memory only, never results).
_MOST_UNITS = 1_500_000
_LONGEST = 32  # bytes of a unit that is kept
_JOINED = 512
_RUN = 1 << 18  # bytes taken at a time
_SLOT_BITS = 22


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Store:
    """Units by hash: their bytes and ids, in flat arrays that grow."""

    def __init__(self, kind: type) -> None:
        self.keys = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.unit = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.count, self.n_bytes, self.n_ids = 0, 0, 0
        self.bytes, self.ids = np.empty(1 << 16, np.uint8), np.empty(1 << 16, kind)
        self.byte_at, self.id_at, self.id_n = np.empty(1 << 12, np.int32), np.empty(1 << 12, np.int32), np.empty(1 << 12, np.uint8)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The unit of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        left, h = np.arange(len(hashes)), hashes
        slot = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        while len(left):
            unit = self.unit[slot]
            here = (self.keys[slot] == h) & (unit >= 0)
            out[left[here]] = unit[here]
            on = ~here & (unit >= 0)
            left, h, slot = left[on], h[on], (slot[on] + 1) & ((1 << _SLOT_BITS) - 1)
        return out

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate((x, np.empty(max(n - len(x), len(x) // 2), x.dtype)))

    def add(self, hashes: np.ndarray, flat: np.ndarray, sizes: np.ndarray, ids: np.ndarray, many: np.ndarray) -> None:
        """New units with distinct hashes that aren't there yet: their bytes and ids
        one after another, and how many each has."""
        to = self.count + len(hashes)
        self.bytes, self.ids = self._room(self.bytes, self.n_bytes + len(flat)), self._room(self.ids, self.n_ids + len(ids))
        self.byte_at, self.id_at, self.id_n = self._room(self.byte_at, to + 1), self._room(self.id_at, to), self._room(self.id_n, to)
        self.bytes[self.n_bytes : self.n_bytes + len(flat)] = flat
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.byte_at[self.count : to] = self.n_bytes + np.cumsum(sizes) - sizes
        self.byte_at[to] = self.n_bytes + len(flat)
        self.id_at[self.count : to] = self.n_ids + np.cumsum(many) - many
        self.id_n[self.count : to] = many
        left, h = np.arange(self.count, to, dtype=np.int32), hashes
        slot = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        while len(left):
            free = self.unit[slot] < 0
            self.unit[slot[free]] = left[free]  # of several that want a slot the last one has it
            here = self.unit[slot] == left
            self.keys[slot[here]] = h[here]
            left, h, slot = left[~here], h[~here], (slot[~here] + 1) & ((1 << _SLOT_BITS) - 1)
        self.count, self.n_bytes, self.n_ids = to, self.n_bytes + len(flat), self.n_ids + len(ids)


#: Bytes that are plainly printable characters (1), or lead such ones of two bytes (2).
_PLAIN = np.zeros(256, np.uint8)
_PLAIN[0x21:0x7F] = 1
_PLAIN[0xC3:0xC9] = 2
#: Kinds of bytes: 1 ASCII letter, 2 point, 3 line feed, 4 other plain ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 4
_KIND[ord("A") : ord("Z") + 1] = _KIND[ord("a") : ord("z") + 1] = 1
_KIND[list(b",.;:!?")] = 2
_KIND[ord("\n")] = 3


def unit_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the units of a run of texts begin; every text that isn't empty begins one."""
    space = np.flatnonzero(data == 0x20)
    space = space[(space > 1) & (space + 1 < len(data))]
    before = (_PLAIN[data[space - 1]] == 1) | ((_PLAIN[data[space - 2]] == 2) & (data[space - 1] & 0xC0 == 0x80))
    cut = np.zeros(len(data) + 1, bool)
    kind = _KIND[data]
    cut[1:-1] = (kind[:-1] == 1) & ((kind[1:] == 2) | (kind[1:] == 3))
    feed = np.flatnonzero(kind[1:-1] == 3) + 1  # of several line feeds the last goes with what follows
    cut[feed[(kind[feed - 1] % 3 > 0) & (kind[feed + 1] % 3 > 0)] + 1] = True
    cut[space[before & (_PLAIN[data[space + 1]] > 0)]] = True
    cut[off[1:] - 1] = False  # a space at a text's end stays with what is before it
    cut[off] = True
    return np.flatnonzero(cut[:-1])


class UnitEncoder:
    """Encodes texts into ids."""

    def __init__(self, path: str, special_ids: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not special_ids
        added = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = added if special_ids else []
        vocab = self._tokenizer.get_vocab(with_added_tokens=True)
        self._opens = np.zeros(max(vocab.values()) + 1, bool)  # ids whose bytes begin with a space
        self._opens[[i for token, i in vocab.items() if token.startswith("Ġ")]] = True
        self._kind = np.uint16 if len(self._opens) <= 1 << 16 else np.uint32
        self._store = _Store(self._kind)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, encoded as it is."""
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(x.ids, np.uint32) for x in found]

    def _fresh(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units (bytes one after another) and how many each has; units
        that are a space and no other are encoded many to a text."""
        ends = np.cumsum(sizes)
        spaces = np.concatenate(([0], np.cumsum(flat == 0x20)))
        plain = (flat[ends - sizes] == 0x20) & (spaces[ends] - spaces[ends - sizes] == 1) & (sizes > 1)
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        n_plain, many = int(plain.sum()), np.zeros(len(sizes), np.int64)
        raw = flat[spans_of((ends - sizes)[order], sizes[order])].tobytes()
        cuts = np.concatenate(([0], np.cumsum(sizes[order]))).tolist()
        firsts = [*range(0, n_plain, _JOINED), n_plain]
        got = self.whole([raw[cuts[i] : cuts[j]].decode() for i, j in itertools.pairwise(firsts)])
        for k, (i, j) in enumerate(itertools.pairwise(firsts)):
            opens = np.flatnonzero(self._opens[got[k]])
            if len(opens) != j - i:  # a unit was not what it seemed
                alone = self.whole([raw[cuts[u] : cuts[u + 1]].decode() for u in range(i, j)])
                got[k], opens = np.concatenate(alone), np.cumsum([0, *map(len, alone[:-1])])
            many[i:j] = np.diff(opens, append=len(got[k]))
        rest = self.whole([raw[cuts[u] : cuts[u + 1]].decode() for u in range(n_plain, len(order))])
        many[n_plain:] = [len(x) for x in rest]
        ids, at = np.concatenate([*got, *rest]), np.cumsum(many) - many
        back = np.argsort(order)
        return ids[spans_of(at[back], many[back])], many[back]

    def _run(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of texts, one after another, and len + 1 offsets into them."""
        start = unit_starts(data, off)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        end = np.concatenate((start[1:], [len(data)]))
        size = end - start
        h = tk.span_hashes(data, start, end)
        store, unit = self._store, self._store.find(h)
        new = np.flatnonzero((unit < 0) & (size <= _LONGEST))
        late = None
        if len(new):
            _, first, again = np.unique(h[new], return_index=True, return_inverse=True)
            some = new[first]
            flat = data[spans_of(start[some], size[some])]
            ids, many = self._fresh(flat, size[some])
            if store.count + len(some) > _MOST_UNITS and len(new) > 0.3 * len(h):
                self._store = _Store(self._kind)  # other texts than before
                return self._run(data, off)
            if store.count + len(some) <= _MOST_UNITS:
                unit[new] = store.count + again
                store.add(h[some], flat, size[some], ids, many)
            else:
                late = (new, again, flat, size[some], ids, many)
        n = np.full(len(start), -1, np.int64)
        known = np.flatnonzero(unit >= 0)
        u = unit[known]
        good = self._same(data, start[known], size[known], store.bytes, store.byte_at[u], store.byte_at[u + 1] - store.byte_at[u])
        known, u = (known, u) if good is None else (known[good], u[good])
        n[known] = store.id_n[u]
        filled = [(known, store.ids, store.id_at[u])]
        if late is not None:
            new, again, flat, sizes, ids, many = late
            begin = np.cumsum(sizes) - sizes
            good = self._same(data, start[new], size[new], flat, begin[again], sizes[again])
            new, again = (new, again) if good is None else (new[good], again[good])
            n[new] = many[again]
            filled.append((new, ids, (np.cumsum(many) - many)[again]))
        odd = np.flatnonzero(n < 0)  # long ones, and those whose hash stands for another unit
        extra = self.whole([data[start[i] : end[i]].tobytes().decode() for i in odd.tolist()])
        n[odd] = [len(x) for x in extra]
        ends = np.cumsum(n)
        if len(known) == len(n):
            out = store.ids[spans_of(store.id_at[u], n)].astype(np.uint32)
        else:
            out = np.empty(int(ends[-1]), np.uint32)
            for units, ids, at in filled:
                out[spans_of((ends - n)[units], n[units])] = ids[spans_of(at, n[units])]
            for i, x in zip((ends - n)[odd].tolist(), extra, strict=True):
                out[i : i + len(x)] = x
        return out, np.concatenate(([0], ends))[np.searchsorted(start, off)]

    @staticmethod
    def _same(data: np.ndarray, start: np.ndarray, size: np.ndarray, kept: np.ndarray, at: np.ndarray, kept_size: np.ndarray) -> np.ndarray | None:
        """Which units are those that were found for them; None if all are."""
        if np.array_equal(size, kept_size):
            differs = kept[spans_of(at, size)] != (data if int(size.sum()) == len(data) else data[spans_of(start, size)])
            if not differs.any():
                return None
            return np.add.reduceat(differs.astype(np.int64), np.cumsum(size) - size) == 0
        equal = size == kept_size
        some = np.flatnonzero(equal)
        inner = UnitEncoder._same(data, start[some], size[some], kept, at[some], kept_size[some]) if len(some) else None
        if inner is not None:
            equal[some] = inner
        return equal

    def runs(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of rows of a string column: first row, row after the last, the
        ids of their texts, one after another, and offsets into them.  A null text
        is an empty one."""
        data, off = tk.text_bytes(column)
        for a, b in tk.runs(off, _RUN):
            d, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
            raw = d.tobytes() if self._special else b""
            if not any(x in raw for x in self._special):
                yield (a, b, *self._run(d, o))
                continue
            for i in range(b - a):
                text = raw[o[i] : o[i + 1]]
                if any(x in text for x in self._special):
                    ids = self.whole([text.decode()])[0]
                    yield a + i, a + i + 1, ids, np.array([0, len(ids)])
                else:
                    yield (a + i, a + i + 1, *self._run(d[o[i] : o[i + 1]], o[i : i + 2] - o[i]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers; null is empty."""
        out: list[bytes] = []
        for _, _, ids, off in self.runs(pa.array(texts, pa.large_string())):
            raw = ids.astype("<u4").tobytes()
            out += [raw[4 * i : 4 * j] for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, special_ids: bool = True) -> UnitEncoder:
    """One encoder for each worker process and vocabulary."""
    return UnitEncoder(path, special_ids)
