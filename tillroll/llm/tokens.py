"""Byte-level BPE ids of whole Arrow batches.

The file is a public tokenizer in the ``tokenizers`` JSON format; ids equal that library's: with ``added``, those of ``encode(text,
add_special_tokens=False)`` as it stands, where an added token that a text spells out (``<|endoftext|>``) gets its own id; without,
those of ``encode_special_tokens = True``, where it is text like any other. The queries use the former. Texts repeat
their words, so a batch is cut into word pieces with vectorised character classes, and pieces are looked up in a
table of fixed size by a 64-bit name; only pieces that aren't there are encoded. What the table holds changes the speed, never the ids.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tillroll.llm import scan

#: slots of the piece table, and ids that it may hold before it starts anew
SLOTS = 1 << 20
POOL = 8 << 20
OTHER, LETTER, NUMBER, BLANK = range(4)
U = np.uint64


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and hash value of each code point."""
    kinds = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c in "LN":
            kinds[i] = LETTER if c == "L" else NUMBER
    kinds[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    return kinds, scan._splitmix(0x110000, 5)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_pieces(cp: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Starts of the word pieces of code points cp; row: the start of each row, ascending.

    A piece is a contraction suffix ('s 't 're 've 'm 'll 'd), or a run of letters, of numbers or of other
    signs, each with one space before it if there is one, or white space; before other text, the last white space
    stands alone.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[0][cp]
    edge = np.zeros(n + 1, bool)
    edge[row[row < n]] = True
    edge[n] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    blank = kind == BLANK
    tail = np.flatnonzero(blank[:-1] & ~blank[1:] & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)  # last white space before text
    start[tail] = True
    start[tail[cp[tail] == 0x20] + 1] = False
    q = np.flatnonzero(start & (cp == 0x27))
    if len(q):
        ahead = np.concatenate((cp, np.zeros(3, cp.dtype)))
        border = np.concatenate((edge, np.ones(3, bool)))
        a, b = ahead[q + 1], ahead[q + 2]
        one = ~border[q + 1] & np.isin(a, [ord(x) for x in "stmd"])
        two = ~border[q + 1] & ~border[q + 2] & np.isin(a * 0x200000 + b, [ord(x) * 0x200000 + ord(y) for x, y in ("re", "ve", "ll")])
        for hit, size in ((one, 2), (two, 3)):
            s = q[hit]
            for k in range(1, size):
                start[s + k] = False
            s = s + size
            start[s[s < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of rows of text; one a worker, see :func:`encoder`."""

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        special = {t["content"] for t in model.get("added_tokens", ())}
        self.added = {t["content"]: t["id"] for t in model.get("added_tokens", ()) if t["content"]} if added else {}
        if added and any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in model.get("added_tokens", ())):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.find = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in printable)}
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.size = max(vocab.values()) + 1
        self.core = tiktoken.Encoding("byte_bpe", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._fresh()

    def _fresh(self) -> None:
        self.key, self.at, self.count = np.zeros(SLOTS, U), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0

    def _add(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        count = np.array([len(x) for x in lists], np.int64)
        flat = np.fromiter((i for x in lists for i in x), np.uint32, int(count.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool[:self.used], np.empty(max(len(self.pool), len(flat)), np.uint32)))
        self.pool[self.used:self.used + len(flat)] = flat
        at = self.used + np.cumsum(count) - count
        self.used += len(flat)
        return at, count

    def _spelled(self, text: str, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the added tokens within each row."""
        found = []
        if self.find is not None and self.find.search(text):
            for lo, hi in zip(row[:-1].tolist(), row[1:].tolist(), strict=True):
                found += [m.span() for m in self.find.finditer(text, lo, hi)]
        spans = np.array(found, np.int64).reshape(-1, 2)
        return spans[:, 0], spans[:, 1]

    def _encode(self, piece: str) -> list[int]:
        whole = self.added.get(piece)
        return [whole] if whole is not None else self.core.encode_single_piece(piece.encode())

    def slab(self, raw: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): ids of all rows raw[off[i]:off[i+1]] and the place in ids where each row starts, one more at the end."""
        if self.used > POOL:
            self._fresh()
        text = raw.decode("utf-8")
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        row = np.concatenate(([0], np.cumsum(lead)))[off]
        lo, hi = self._spelled(text, row)
        start = cut_pieces(cp, np.union1d(row[:-1], np.concatenate((lo, hi))) if len(lo) else row[:-1])
        if len(lo):  # an added token is one piece, what stands before and after it are texts of their own
            k = np.searchsorted(lo, start, side="right") - 1
            start = start[(k < 0) | (start == lo[k]) | (start >= hi[k])]
        end = np.concatenate((start[1:], [len(cp)])) if len(start) else start
        pw, _ = scan.powers(len(cp) + 1)
        c = np.zeros(len(cp) + 1, U)
        np.cumsum(_classes()[1][cp] * pw[:len(cp)], dtype=U, out=c[1:])
        h = scan.span(c, start, end) + (end - start).astype(U) | U(1)
        slot = (h >> U(44)).astype(np.int64)
        at, count = self.at[slot], self.count[slot]
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):
            new, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            i = miss[first]
            a, k = self._add([self._encode(text[x:y]) for x, y in zip(start[i].tolist(), end[i].tolist(), strict=True)])
            at[miss], count[miss] = a[inverse], k[inverse]
            s = slot[i]
            self.key[s], self.at[s], self.count[s] = new, a, k
        place = np.concatenate(([0], np.cumsum(count)))
        ids = self.pool[np.repeat(at - place[:-1], count) + np.arange(place[-1])]
        return ids, place[np.searchsorted(start, row)]


@lru_cache(maxsize=2)
def encoder(path: str, added: bool = False) -> Encoder:
    return Encoder(path, added)


def rows_of_ids(col: pa.Array, path: str, added: bool = False):
    """(row, ids) of a text column, whole texts; null counts as empty. ``added``: added tokens that a text spells out get their ids."""
    data, off = scan.text_buffer(col)
    enc = encoder(path, added)
    for i, j in scan.slabs(off):
        lo = int(off[i])
        ids, place = enc.slab(data[lo:int(off[j])].tobytes(), off[i:j + 1] - lo)
        for r in range(j - i):
            yield i + r, ids[place[r]:place[r + 1]]


