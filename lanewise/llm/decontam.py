"""Benchmark decontamination: word-pair seeds, then Smith-Waterman alignment.

*Seeds.* An alignment that counts is a chain of matching words. Each link between two
of them gains 2 if both sides are neighbours, 1 if one word is left out, put in or
replaced, and nothing otherwise. So the pairs of an item's words, next to each other or
with one word between, that a text holds bound the score from above; an alignment with many
matches needs as many words in common. Stretches that fail both tests cannot hold a copy;
none other is left out, however common its words are and whatever other documents hold.
(Seeds chosen for their rarity would lose edited copies: what an edit leaves intact is also
in every verbatim copy, and so never rare.)

*Align.* Each stretch is aligned locally with the item, word by word (match +2,
mismatch -1, gap -1), then what is left of it on either side. An alignment counts if the
score is at least ``share`` of an exact copy's score, or at least ``long_match`` words match.
A stretch is aligned in windows of a few times the item's words, and an alignment takes
memory in proportion to the window, so neither long items nor long texts that repeat
one need much.

The items are the bounded side: they are worked on in blocks of at most BLOCK_ITEMS,
each with one pass over the documents, so what tasks share never grows beyond a
block. The documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lanewise.llm.common import mix64, read_table, spread
from lanewise.llm.seeds import words_of

MATCH, MISMATCH, GAP = 2, -1, -1
#: Of an exact copy's score; words that match.
SHARE, LONG_MATCH = 0.5, 40
#: Items, and characters of items, that a pass takes at once.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 20_000_000


def smith_waterman(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int]:
    """(score, matches, first, last): the best local alignment; words first..last - 1 of ``text``.

    Among equal scores the alignment with the most matches is taken, then the one that
    begins first, then the one that ends first in the item. A cell holds the score, the
    matches and the beginning in the bits of one number, so two rows are enough; a row's
    gaps are a running maximum, so a row is a few vector operations.
    """
    n, m = len(text), len(item)
    begin = n.bit_length()
    many = begin + m.bit_length()
    kind = np.int64 if many + (2 * m + 1).bit_length() < 63 else object  # Python numbers for items of some 100,000 words
    one = 1 << many
    fresh = np.array([n - j for j in range(n + 1)], kind)  # an alignment that begins after word j: the earlier, the larger
    fall = np.arange(n + 1).astype(kind) * -(GAP * one)
    row, best = fresh, (-1, 0)
    for word in item:
        # A beginning's bits stay as they are, so a cell and what it came from differ by whole scores and matches.
        step = np.where(text == word, MATCH * one + (1 << begin), MISMATCH * one).astype(kind)
        new = np.maximum(row + GAP * one, fresh)
        new[1:] = np.maximum(new[1:], row[:-1] + step)
        row = np.maximum.accumulate(new + fall) - fall
        j = int(np.argmax(row))
        if row[j] > best[0]:
            best = (int(row[j]), j)
    value, last = best
    first = n - (value & ((1 << begin) - 1))
    return value >> many, (value >> begin) & ((1 << (many - begin)) - 1), first, last


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list[str]]]:
    keys, texts, chars = [], [], 0
    for r in benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").toLocalIterator():
        keys.append(r["item_id"])
        texts.append(r["text"])
        chars += len(r["text"])
        if len(keys) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield keys, texts
            keys, texts, chars = [], [], 0
    if keys:
        yield keys, texts


def pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * np.uint64(0xD6E8FEB86659FD93) + second)


class Screen:
    """Items as word hashes, and where in a text one of them may stand."""

    def __init__(self, keys: list, texts: list[str], share: float, long_match: int):
        self.share, self.long_match = share, long_match
        self.keys, self.words = [], []
        for key, text in zip(keys, texts, strict=True):
            hashes = words_of(text)[0]
            if len(hashes):
                self.keys.append(key)
                self.words.append(hashes)
        self.n = np.array([len(w) for w in self.words], np.int64)
        flat, self.owner = np.concatenate([np.empty(0, np.uint64), *self.words]), np.repeat(np.arange(len(self.n)), self.n)
        left = np.repeat(np.cumsum(self.n), self.n) - np.arange(len(flat))
        near, apart = np.flatnonzero(left > 1), np.flatnonzero(left > 2)
        # Of items of which one word is enough, every word is looked up.
        single = np.flatnonzero((share * self.n <= 1)[self.owner])
        self.single = np.unique(flat[single])
        gram = np.concatenate([pairs(flat[near], flat[near + 1]), pairs(flat[apart], flat[apart + 2])])
        order = np.argsort(gram, kind="stable")
        self.slot, self.near = np.concatenate([near, apart])[order], order < len(near)
        self.gram, self.first, self.many = np.unique(gram[order], return_index=True, return_counts=True)
        # A sieve of low bits keeps most of a text's pairs from the search.
        self.mask = np.uint64((1 << max(20, (8 * len(gram)).bit_length())) - 1)
        self.sieve = np.zeros(int(self.mask) + 1, bool)
        self.sieve[(self.gram & self.mask).astype(np.int64)] = True
        self.gain, self.last = np.zeros(len(flat), np.int8), np.zeros(len(flat), np.int64)
        # Words of the items that can match long_match words: (item, word, times), by item.
        self.long = np.flatnonzero(self.n >= long_match)
        self.known = np.unique(np.concatenate([np.empty(0, np.uint64), *[self.words[i] for i in self.long]]))
        bags = [np.unique(np.searchsorted(self.known, self.words[i]), return_counts=True) for i in self.long]
        self.bag_word = np.concatenate([np.empty(0, np.int64), *[b[0] for b in bags]]).astype(np.int64)
        self.bag_times = np.concatenate([np.empty(0, np.int64), *[b[1] for b in bags]]).astype(np.int64)
        self.bag_from = np.concatenate([[0], np.cumsum([len(b[0]) for b in bags])]).astype(np.int64)

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, place in the items, gain) of every pair in common."""
        g = np.concatenate([pairs(hashes[:-1], hashes[1:]), pairs(hashes[:-2], hashes[2:])])
        maybe = np.flatnonzero(self.sieve[(g & self.mask).view(np.int64)])
        if not len(maybe) or not len(self.gram):
            return (np.empty(0, np.int64),) * 3
        k = np.minimum(np.searchsorted(self.gram, g[maybe]), len(self.gram) - 1)
        same = self.gram[k] == g[maybe]
        k, maybe = k[same], maybe[same]
        n, beside = self.many[k], maybe < len(hashes) - 1
        row = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(maybe - ~beside * (len(hashes) - 1), n), self.slot[row], 1 + (self.near[row] & np.repeat(beside, n))

    def stretches(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first word, last word) wherever an alignment may count; those of an item don't overlap."""
        out = self._single(hashes)
        at, slot, gain = self.hits(hashes)
        if not len(at):
            return out
        self.gain[slot] = 1
        self.gain[slot[gain == 2]] = 2
        places = slot[self._once(slot)]
        most = MATCH + np.bincount(self.owner[places], self.gain[places], len(self.n))
        self.gain[places] = 0
        found = self._dense(at, slot, gain, np.flatnonzero((most > MATCH) & (most >= self.share * MATCH * self.n) & (self.share * self.n > 1)))
        if len(self.long) and len(hashes) >= self.long_match:
            word = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            word[self.known[word] != hashes] = len(self.known)
            times = np.bincount(word, minlength=len(self.known) + 1)
            common = np.add.reduceat(np.minimum(self.bag_times, times[self.bag_word]), self.bag_from[:-1])
            held = np.flatnonzero((common >= self.long_match) & (most[self.long] > MATCH) & (self.share * self.n[self.long] > 1))
            if len(held):
                places = np.argsort(word, kind="stable")
                word = word[places]
                for k in held:
                    found.setdefault(int(self.long[k]), []).extend(self._common(word, places, k))
        for i, ranges in found.items():
            merged: list[list[int]] = []
            for lo, hi in sorted(ranges):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(hi, merged[-1][1])
                else:
                    merged.append([lo, hi])
            out += [(i, max(0, lo), min(len(hashes), hi)) for lo, hi in merged]
        return out

    def _single(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """The whole text for the items of which it holds a word that is enough."""
        if not len(self.single) or not np.isin(hashes, self.single).any():
            return []
        return [(int(i), 0, len(hashes)) for i in np.flatnonzero(self.share * self.n <= 1) if np.isin(self.words[i], hashes).any()]

    def _once(self, slot: np.ndarray) -> np.ndarray:
        """Of equal places one."""
        k = np.arange(len(slot))
        self.last[slot] = k
        return self.last[slot] == k

    def _dense(self, at, slot, gain, items: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each item, surroundings of the places from which on an alignment's longest span has pairs enough."""
        if not len(items):
            return {}
        wanted = np.zeros(len(self.n), bool)
        wanted[items] = True
        mine = np.flatnonzero(wanted[self.owner[slot]])
        mine = mine[np.lexsort((at[mine], self.owner[slot[mine]]))]
        whose, place, sums = self.owner[slot[mine]], at[mine], np.concatenate([[0], np.cumsum(gain[mine])])
        out = {}
        for i, a, b in zip(items.tolist(), np.searchsorted(whose, items, "left").tolist(), np.searchsorted(whose, items, "right").tolist(), strict=True):
            p, total = place[a:b], sums[a : b + 1]
            # Of m words at most, with penalties of at most 2 * m * (1 - share).
            span = int(np.ceil(self.n[i] * (3 - 2 * min(1.0, self.share)))) + 1
            enough = MATCH + total[np.searchsorted(p, p + span, "right")] - total[:-1] >= self.share * MATCH * self.n[i]
            out[i] = [(q - span, q + span) for q in p[enough].tolist()]
        return out

    def _common(self, word: np.ndarray, places: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Spans of three times the item's words, the most that a positive score allows, with long_match words in common.

        ``word`` is sorted, ``places`` says where in the text each stands: the cost is by the places of the item's own words.
        """
        bag = slice(self.bag_from[k], self.bag_from[k + 1])
        first = np.searchsorted(word, self.bag_word[bag], "left")
        n = np.searchsorted(word, self.bag_word[bag], "right") - first
        p, times, which = places[spread(first, n)], np.repeat(self.bag_times[bag], n), np.repeat(np.arange(len(n)), n)
        # A place counts for the spans that start after the place where its word stood ``times`` occurrences ago.
        back, c = np.arange(len(p)) - times, 3 * int(self.n[self.long[k]])
        then = np.maximum(back, 0)
        before = np.where((back >= 0) & (which[then] == which), p[then], -1)
        at = np.concatenate([np.maximum(before, p - c) + 1, p + 1])
        order = np.argsort(at, kind="stable")
        at, level = at[order], np.cumsum(np.repeat([1, -1], len(p))[order])
        full = np.flatnonzero((level[:-1] >= self.long_match) & (at[1:] > at[:-1]))
        return [(a, b - 1 + c) for a, b in zip(at[full].tolist(), at[full + 1].tolist(), strict=True)]


def aligned(screen: Screen, hashes: np.ndarray) -> Iterator[tuple]:
    """(item's key, similarity, matches, first word, word after the last) of all alignments that count.

    A window of a stretch is four times as long as an alignment can be; what begins in its
    last quarter is left to the next window.
    """
    for i, lo, hi in screen.stretches(hashes):
        item = screen.words[i]
        span, least = 3 * len(item) + 1, max(1, min(int(np.ceil(screen.share * len(item))), screen.long_match))
        while lo < hi:
            end = min(hi, lo + 4 * span)
            whole = end == hi
            todo, done = [(lo, end)], lo
            held = lo + np.flatnonzero(np.isin(hashes[lo:end], item))
            while todo:
                a, b = todo.pop()
                own = held[slice(*np.searchsorted(held, (a, b)))]
                if len(own) < least:  # fewer of the item's words can't match enough
                    continue
                a, b = int(own[0]), int(own[-1]) + 1  # an alignment begins and ends with a match
                score, matches, first, last = smith_waterman(hashes[a:b], item)
                if not score or not (score >= screen.share * MATCH * len(item) or matches >= screen.long_match):
                    continue
                if whole or a + first < end - span:
                    yield screen.keys[i], score / (MATCH * len(item)), matches, a + first, a + last
                    done = max(done, a + last)
                    todo.append((a + last, b))
                todo.append((a, a + first))
            lo = hi if whole else max(end - span, done)


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, long_match: int = LONG_MATCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, matches, start_word, end_word): items found in documents.

    Words are lower-cased (A-Z) and freed of ASCII punctuation. One row for each
    stretch; similarity is the alignment's score as a share of an exact copy's. Null or
    wordless texts and items give nothing, repeated rows give rows of their own, an
    empty table on either side gives an empty result, other columns are ignored. Ids may be
    of any type.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = {"doc_id": docs.schema["doc_id"].dataType, "item_id": benchmark.schema["item_id"].dataType}
    schema = f"doc_id {ids['doc_id'].simpleString()}, item_id {ids['item_id'].simpleString()}, similarity double, matches long, start_word long, end_word long"
    kinds = pa.schema([*[(name, to_arrow_type(kind)) for name, kind in ids.items()], ("similarity", pa.float64()), *[(c, pa.int64()) for c in ("matches", "start_word", "end_word")]])
    found = []
    for keys, texts in _blocks(benchmark):
        shared = spark.sparkContext.broadcast((keys, texts))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            screen = Screen(*shared.value, share, long_match)
            for b in batches:
                out = []
                for doc, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                    hashes = words_of(t)[0] if t else ()
                    out += [(doc, *x) for x in aligned(screen, hashes)] if len(hashes) else []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

        found.append(docs.mapInArrow(work, schema))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and test item of which the document holds an exact, edited or partial copy."""
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max("matches").alias("matches"), F.count("*").alias("stretches"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no test item is found, with their columns unchanged."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("bad")).dropDuplicates()
    return docs.join(bad, docs["doc_id"] == bad["bad"], "left_anti")
