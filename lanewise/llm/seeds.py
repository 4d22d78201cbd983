"""Word n-gram seeds of a bounded set of passages, found in whole texts by hash."""

from __future__ import annotations

import numpy as np

from lanewise.llm.common import SPACE, mix64, word_hashes

#: Bytes to bytes of the same number: A-Z become a-z, ASCII punctuation and controls become spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str) -> bytes:
    """UTF-8 with letters A-Z in lower case and without ASCII punctuation; offsets stay."""
    return text.encode("utf-8", "replace").translate(_PLAIN)


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, byte starts, byte ends) of a text's words."""
    return word_hashes(plain(text), SPACE)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words, or of the whole sequence if it is shorter."""
    n = min(n, len(hashes))
    if not n:
        return np.empty(0, np.uint64)
    out = np.full(len(hashes) - n + 1, np.uint64(n))
    for i in range(n):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : len(hashes) - n + 1 + i])
    return out


class Passages:
    """Passages as word hashes, with an index of their n-grams."""

    def __init__(self, keys: list, texts: list[str], n: int):
        self.n = n
        self.keys, self.words = [], []
        for key, text in zip(keys, texts, strict=True):
            hashes = words_of(text)[0]
            if len(hashes):
                self.keys.append(key)
                self.words.append(hashes)
        grams = [ngrams(w, n) for w in self.words]
        self.gram = np.concatenate([np.empty(0, np.uint64), *grams])
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        self.place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(g)) for g in grams]]).astype(np.int64)
        self.short = sorted({len(w) for w in self.words if len(w) < n})
        self.row = np.argsort(self.gram, kind="stable")
        self.by_gram = self.gram[self.row]
        # A sieve of low bits keeps most of a text's n-grams from the search.
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.by_gram & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, row of the index) of every n-gram that a text's words hold."""
        at, row = [], []
        for n in {self.n, *self.short}:
            if len(hashes) < n:
                continue
            g = ngrams(hashes, n)
            maybe = np.flatnonzero(self.sieve[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if not len(maybe):
                continue
            lo, hi = np.searchsorted(self.by_gram, g[maybe], "left"), np.searchsorted(self.by_gram, g[maybe], "right")
            for p, a, b in zip(maybe[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                at += [p] * (b - a)
                row += self.row[a:b].tolist()
        return np.asarray(at, np.int64), np.asarray(row, np.int64)
