"""Phrase collocation mining by SON partitioning.

*Shards.* Each task reads its documents in shards of bounded size. A phrase that holds the
wanted support over all text of a language holds, in at least one shard, the same
proportion of it: support * (words of the shard) / (words of the language). Every shard is mined
completely at that lowered support, level by level: a phrase is counted only where both its parts
without the last and without the first word are locally frequent.

*Possible phrases.* With very many shards local supports fall to one, and all phrases would be named. Then hashes of phrases
of one, two and three words are counted over all text first, length by length, and shards name what is made of possible ones.

*Union.* Locally frequent phrases, packed by a hash of their words, come together with the counts that are known. A shard that didn't name a phrase
holds it less often than its local support, which bounds what is still unknown; a phrase whose
bound stays below the support is no candidate. Where local support is one, as in corpora of very many shards, every
count is known already and the second pass has nothing left to do.

*Count.* The candidates, closed under prefixes, are a trie of integers. Each task
follows all of its text down the trie and counts every candidate exactly; the counts are added up. A trie
beyond TRIE_PHRASES isn't sent to the tasks; then every shard names all its phrases, whose counts add up to the exact ones.

*Scores.* Cuts and containing phrases are equality joins on the counted phrases; products are decimals of 38
digits, and the division keeps whole numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import drop_scratch, mix64, read_table, span_hashes, spread, word_hashes, write_scratch

SUPPORT, MOST_WORDS, TOP = 100, 5, 2_000
#: Bytes of a shard, about: a shard ends with a document, and a task leaves no rest of less than half a shard.
SHARD_BYTES = 20 << 20
#: Phrases of a trie that is sent to all tasks, at most, and their bytes.
TRIE_PHRASES, TRIE_BYTES = 2_000_000, 64 << 20
#: Words of the phrases whose hashes are counted over all text before shards of a low local support are mined.
FILTERED_WORDS = 3
#: Counts of a block that is added up at once.
BLOCK = 4_096
#: Bytes of text for each bucket of phrases that come together in one task, about.
BUCKET_BYTES = 4 << 20
#: Languages whose local support is known to the tasks; in smaller ones it is one, which names every phrase.
KNOWN_LANGUAGES = 10_000

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_BETWEEN = _BREAK.copy()
_BETWEEN[list(b" \t")] = True


class Words:
    """The words of many texts: their places in the lower-cased bytes, their hashes, and the piece of each."""

    def __init__(self, texts: list[bytes]):
        raw, hashes, starts, lengths, size = [], [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)], 0
        for lo, part in _portions(texts):
            h, s, e = word_hashes(part, _BETWEEN)
            raw.append(part)
            hashes.append(h)
            starts.append((s + size).astype(np.int32))
            lengths.append((e - s).astype(np.int32))
            size += len(part)
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        del raw
        self.hashes, self.starts, self.lengths = map(np.concatenate, (hashes, starts, lengths))
        piece = np.cumsum(_BREAK[self.bytes], dtype=np.int32)[self.starts]
        self.new_piece = np.r_[True, piece[1:] != piece[:-1]][: len(piece)]

    def text(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()

    def equal(self, at: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Whether each word ``at`` has exactly the bytes of the span of ``flat`` that ``pair`` numbers."""
        same = np.empty(len(at), bool)
        for lo in range(0, len(at), 200_000):
            own, other = at[lo : lo + 200_000], pair[lo : lo + 200_000]
            alike = self.lengths[own] == lengths[other]
            n = self.lengths[own[alike]].astype(np.int64)
            differ = self.bytes[spread(self.starts[own[alike]], n)] != flat[spread(starts[other[alike]], n)]
            if len(n):
                alike[alike] = np.add.reduceat(differ, np.cumsum(n) - n) == 0
            same[lo : lo + 200_000] = alike
        return same

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """A number from 1 on for each word, and a word of each number (from 1 on; at 0 stands 0)."""
        if not len(self.hashes):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        order = np.argsort(self.hashes)
        value = self.hashes[order]
        new = np.r_[True, value[1:] != value[:-1]][: len(value)]
        number = np.empty(len(order), np.int32)
        number[order] = np.cumsum(new, dtype=np.int32)
        one = np.r_[0, order[new]]
        del order, value, new
        if self.equal(np.arange(len(number), dtype=np.int32), self.bytes, self.starts[one], self.lengths[one], number).all():
            return number, one
        # Two words share a hash.
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(self.text(i), len(known) + 1) for i in range(len(number))], np.int32)
        one = np.zeros(len(known) + 1, np.int64)
        one[number] = np.arange(len(number))
        return number, one

    def pieces(self, number: np.ndarray) -> np.ndarray:
        """The numbers in text order, with 0 between pieces and at both ends."""
        out = np.zeros(len(number) + int(self.new_piece.sum()) + 1, np.int32)
        out[np.arange(len(number)) + np.cumsum(self.new_piece)] = number
        return out


def _portions(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Texts with a line end after each, put together up to about ``limit`` bytes."""
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= limit or i + 1 == len(texts):
            yield i, b"\n".join([*held, b""])
            held, size = [], 0


def lowered(text: str) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower()


def frequent(x: np.ndarray, least: int, most_words: int, possible: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each length a position and the count of every phrase that occurs ``least`` times or more.

    ``possible`` takes a length and places, and says which of the phrases there can be wanted; no phrase that holds another is then looked at.
    """
    inside = np.flatnonzero(x).astype(np.int32)
    base = int(x.max(initial=0)) + 1
    code = x[inside].astype(np.int64)
    for m in range(1, most_words + 1):
        if possible:
            wanted = possible(m, inside)
            inside, code = inside[wanted], code[wanted]
        if not len(inside):
            return
        order = np.argsort(code).astype(np.int32)
        value = code[order]
        begin = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        counts = np.diff(np.r_[begin, len(value)])
        keep = counts >= least
        yield inside[order[begin[keep]]], counts[keep], m
        label = np.full(len(x), -1, np.int32)
        label[inside[order]] = np.repeat(np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32), counts)
        del order, value
        # Longer phrases begin where this one and the one a word further on are both frequent.
        inside = np.flatnonzero((label[:-1] >= 0) & (label[1:] >= 0)).astype(np.int32)
        code = label[inside].astype(np.int64) * base + x[np.minimum(inside + m, len(x) - 1)]


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[dict[str, list[bytes]]]:
    """Lower-cased texts by language, whole documents, about ``shard_bytes`` at a time; less than half of that at the end joins the shard before.

    Small shards have small local supports, and so name many phrases.
    """
    full: dict[str, list[bytes]] = {}
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
            held.setdefault(lang, []).append(lowered(text))
            size += len(text)
            if full and size >= shard_bytes // 2:
                yield full
                full = {}
            if size >= shard_bytes:
                full, held, size = held, {}, 0
    for lang, texts in held.items():
        full.setdefault(lang, []).extend(texts)
    yield full


_MINED = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("m", pa.int32()), ("phrases", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("slack", pa.int64())])


def _phrase_hashes(lang: str, hashes: np.ndarray, x: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """A hash of the language and the ``m`` words from each place on; ``hashes`` are those of the word numbers."""
    h = np.full(len(at), zlib.crc32(lang.encode("utf-8", "surrogatepass")), np.uint64)
    for k in range(m):
        h = mix64(h + hashes[x[at + k]])
    return h


def _among(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)] == h if len(sorted_) else np.zeros(len(h), bool)


def _possible(docs: DataFrame, support: int, most_words: int, shard_bytes: int, buckets: int, most: int) -> list[np.ndarray]:
    """For lengths from 1 on the sorted hashes of the phrases that hold the support over all text: a phrase whose hash isn't there can't hold it.

    Length by length, over the phrases both of whose parts are there; of every shard only hashes and counts are shuffled. Two
    phrases with one hash add up, which lets one more through and loses none. Ends before a length of more than ``most`` hashes.
    """
    spark, out = docs.sparkSession, []
    for m in range(1, min(FILTERED_WORDS, most_words) + 1):
        sent = spark.sparkContext.broadcast(list(out))

        def work(batches: Iterator[pa.RecordBatch], m: int = m, sent=sent) -> Iterator[pa.RecordBatch]:
            for held in _shards(batches, shard_bytes):
                for lang in list(held):
                    words = Words(held.pop(lang))
                    number, one = words.numbers()
                    x = words.pieces(number)
                    if not len(number):
                        continue
                    hashes = words.hashes[one]
                    at = np.flatnonzero(x)
                    for k, known in enumerate(sent.value, 1):  # places where a phrase of k words begins that can hold the support
                        begins = np.zeros(len(x), bool)
                        begins[at] = _among(known, _phrase_hashes(lang, hashes, x, at, k))
                        at = np.flatnonzero(begins[:-1] & begins[1:])
                    h, n = np.unique(_phrase_hashes(lang, hashes, x, at, m), return_counts=True)
                    # Sorted hashes of a bucket lie together: a bucket is a range.
                    bucket = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                    present, begin = np.unique(bucket, return_index=True)
                    offsets = pa.array(np.r_[begin, len(h)].astype(np.int32))
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (h.view(np.int64), n.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), *lists], ["bucket", "hashes", "counts"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def wanted(held: list[tuple]) -> pa.RecordBatch:
                h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
                n = np.bincount(at, np.concatenate([x for _, x in held]), len(h))
                return pa.RecordBatch.from_arrays([pa.array(h[n >= support])], ["h"])

            of, held = None, []
            for b in batches:
                for i, bucket in enumerate(b["bucket"].to_pylist()):
                    if bucket != of and held:
                        yield wanted(held)
                        held = []
                    of = bucket
                    held.append((b["hashes"][i].values.to_numpy(), b["counts"][i].values.to_numpy()))
            if held:
                yield wanted(held)

        counted = docs.mapInArrow(work, "bucket int, hashes array<long>, counts array<int>").repartition(buckets, "bucket").sortWithinPartitions("bucket")
        found = write_scratch(counted.mapInArrow(add, "h long"), "phrase-hashes")
        few = found.count() <= most
        if few:
            out.append(np.sort(found.toArrow()["h"].to_numpy().view(np.uint64)))
        drop_scratch(found)
        if not few:
            break
    return out


def _mined(docs: DataFrame, totals: dict[str, int] | None, support: int, most_words: int, shard_bytes: int, buckets: int, hashes_known: list[np.ndarray] | None = None) -> DataFrame:
    """(bucket, lang, m, phrases, counts, slack): locally frequent phrases of every shard, packed by a hash; with ``m`` 0, a row for the shard alone.

    ``slack`` is how often the shard may hold a phrase that it doesn't name. Without ``totals`` every phrase is named; with
    ``hashes_known`` (see :func:`_possible`) only phrases that these let through, and the slack is that of phrases with the support.
    """
    sent = docs.sparkSession.sparkContext.broadcast(hashes_known or [])

    def shard(held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang in list(held):
            words = Words(held.pop(lang))
            n_words = len(words.hashes)
            total = (totals or {}).get(lang)
            least = max(1, -(-support * n_words // total)) if total else 1
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((-1, lang, 0, [], [], least - 1), _MINED, strict=True)], schema=_MINED)
            number, one = words.numbers()
            x = words.pieces(number)
            hashes = words.hashes[one] if n_words else words.hashes
            del number
            words.hashes = None
            name: dict[int, str] = {}
            known = sent.value
            possible = (lambda m, at: _among(known[m - 1], _phrase_hashes(lang, hashes, x, at, m)) if m <= len(known) else np.ones(len(at), bool)) if known else None  # noqa: B023
            for first, counts, m in frequent(x, least, most_words, possible):
                if m == 1:
                    name = {i: words.text(one[i]).decode("utf-8", "replace") for i in x[first].tolist()}
                for lo in range(0, len(first), 100_000):
                    phrase = x[first[lo : lo + 100_000, None] + np.arange(m)]
                    h = np.zeros(len(phrase), np.uint64)
                    for column in phrase.T:
                        h = mix64(h + hashes[column])
                    bucket = (h % np.uint64(buckets)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    present, begin = np.unique(bucket[order], return_index=True)
                    offsets = pa.array(np.r_[begin, len(order)], pa.int32())
                    texts = pa.array([" ".join([name[i] for i in p]) for p in phrase[order].tolist()], pa.string())
                    size = len(present)
                    columns = [pa.array(present), pa.array([lang] * size, pa.string()), pa.array([m] * size, pa.int32()), pa.ListArray.from_arrays(offsets, texts)]
                    columns += [pa.ListArray.from_arrays(offsets, pa.array(counts[lo : lo + 100_000][order], pa.int64())), pa.array([least - 1] * size, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, schema=_MINED)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _shards(batches, shard_bytes):
            yield from shard(held)

    return docs.mapInArrow(work, "bucket int, lang string, m int, phrases array<string>, counts array<long>, slack long")


def _united(mined: DataFrame, slack: dict[str, int], support: int, buckets: int) -> DataFrame:
    """(lang, m, phrase, n, unknown): the phrases that can have the support; ``slack``: of all shards of each language."""

    def candidates(parts: list[pa.Table]) -> pa.Table:
        flat = pa.concat_tables(parts).group_by(["lang", "m", "phrase"]).aggregate([("n", "sum"), ("slack", "sum")])
        whole = np.array([slack.get(x, 0) for x in flat["lang"].to_pylist()], np.int64)
        unknown = whole - flat["slack_sum"].to_numpy()
        out = pa.table([flat["lang"], flat["m"], flat["phrase"], flat["n_sum"], pa.array(unknown)], names=["lang", "m", "phrase", "n", "unknown"])
        return out.filter(pa.array(flat["n_sum"].to_numpy() + unknown >= support))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for i, bucket in enumerate(b["bucket"].to_pylist()):
                if bucket != at and held:
                    yield from candidates(held).to_batches()
                    held = []
                at = bucket
                phrases = b["phrases"][i].values
                size = len(phrases)
                held.append(pa.table([pa.repeat(b["lang"][i], size), pa.repeat(b["m"][i], size), phrases, b["counts"][i].values, pa.repeat(b["slack"][i], size)], names=["lang", "m", "phrase", "n", "slack"]))
        if held:
            yield from candidates(held).to_batches()

    packed = mined.where("m > 0").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return packed.mapInArrow(work, "lang string, m int, phrase string, n long, unknown long")


class Trie:
    """Phrases of one language, closed under prefixes: for each length, sorted codes of (prefix, last word)."""

    def __init__(self, phrases: list[list[str]]):
        words = [p[0] for p in phrases if len(p) == 1]
        raw = [w.encode() for w in words]
        self.lengths = np.array([len(w) for w in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.hashes = np.concatenate([np.empty(0, np.uint64), *(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])) for w in raw)])
        self.order = np.argsort(self.hashes)
        self.unique = len(np.unique(self.hashes)) == len(raw)
        number = {w: i + 1 for i, w in enumerate(words)}
        self.base = len(words) + 1
        self.names = [words]
        self.levels: list[np.ndarray] = [np.arange(1, self.base)]
        place = {w: i for i, w in enumerate(words)}
        for m in range(2, max(map(len, phrases), default=0) + 1):
            long = [p for p in phrases if len(p) == m]
            code = np.array([place[" ".join(p[:-1])] * self.base + number[p[-1]] for p in long], np.int64)
            order = np.argsort(code)
            self.levels.append(code[order])
            self.names.append([" ".join(long[i]) for i in order.tolist()])
            place = {p: i for i, p in enumerate(self.names[-1])}

    def numbers(self, words: Words) -> np.ndarray:
        """Each word's number; 0 for a word that no phrase holds."""
        if not len(self.hashes):
            return np.zeros(len(words.hashes), np.int64)
        if not self.unique:  # two words share a hash
            known = {self.flat[s : s + n].tobytes(): i + 1 for i, (s, n) in enumerate(zip(self.starts, self.lengths, strict=True))}
            return np.array([known.get(words.text(i), 0) for i in range(len(words.hashes))], np.int64)
        found = self.order[np.minimum(np.searchsorted(self.hashes, words.hashes, sorter=self.order), len(self.order) - 1)]
        out = np.zeros(len(found), np.int64)
        at = np.flatnonzero(self.hashes[found] == words.hashes)
        at = at[words.equal(at, self.flat, self.starts, self.lengths, found[at])]
        out[at] = found[at] + 1
        return out

    def counted(self, x: np.ndarray) -> list[np.ndarray]:
        """Occurrences of every phrase of each level in numbered text."""
        at = np.flatnonzero(x)
        node = x[at].astype(np.int64) - 1
        out = [np.bincount(node, minlength=len(self.levels[0]))]
        for m, codes in enumerate(self.levels[1:], 1):
            last = x[np.minimum(at + m, len(x) - 1)]
            at, node, last = at[last > 0], node[last > 0], last[last > 0]
            code = node * self.base + last
            found = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            hit = codes[found] == code if len(codes) else np.zeros(len(code), bool)
            at, node = at[hit], found[hit]
            out.append(np.bincount(node, minlength=len(codes)))
        return out


def _counted(docs: DataFrame, candidates: DataFrame, shard_bytes: int) -> DataFrame:
    """(lang, m, phrase, n): exact counts of candidates that are few enough to be sent to every task."""
    spark = docs.sparkSession
    by_lang: dict[str, list[list[str]]] = {}
    listed = candidates.select("lang", "phrase").toArrow()
    for lang, phrase in zip(listed["lang"].to_pylist(), listed["phrase"].to_pylist(), strict=True):
        by_lang.setdefault(lang, []).append(phrase.split(" "))
    sent = spark.sparkContext.broadcast({lang: Trie(p) for lang, p in by_lang.items()})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = sent.value
        sums: dict[str, list[np.ndarray]] = {}
        for held in _shards(batches, shard_bytes):
            for lang in list(held):
                texts = held.pop(lang)
                if lang in tries:
                    words = Words(texts)
                    counts = tries[lang].counted(words.pieces(tries[lang].numbers(words)))
                    sums[lang] = [a + b for a, b in zip(sums[lang], counts, strict=True)] if lang in sums else counts
        for lang, levels in sums.items():
            for m, counts in enumerate(levels, 1):
                starts = range(0, len(counts), BLOCK)
                blocks = [counts[lo : lo + BLOCK].astype("<i8").tobytes() for lo in starts]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(blocks), pa.string()), pa.array([m] * len(blocks), pa.int32()), pa.array(starts, pa.int64()), pa.array(blocks, pa.binary())], ["lang", "m", "first", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for lang, m, first, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = np.frombuffer(counts, "<i8")
                sums[lang, m, first] = sums[lang, m, first] + part if (lang, m, first) in sums else part
        for (lang, m, first), n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([m] * len(n), pa.int32()), pa.array(first + np.arange(len(n)), pa.int64()), pa.array(n, pa.int64())], ["lang", "m", "node", "n"])

    def names() -> Iterator[tuple[str, int, int, str]]:
        for lang, trie in sent.value.items():
            for m, level in enumerate(trie.names, 1):
                yield from ((lang, m, i, p) for i, p in enumerate(level))

    columns = list(zip(*names(), strict=True)) or [(), (), (), ()]
    table = pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["lang", "m", "node", "phrase"])
    # Each task's counts go on as blocks of numbers, which are added up block by block.
    sums = docs.mapInArrow(work, "lang string, m int, first long, counts binary").repartition("lang", "m", "first").mapInArrow(add, "lang string, m int, node long, n long")
    return sums.join(spark.createDataFrame(table), ["lang", "m", "node"]).select("lang", "m", "phrase", "n")


def phrase_counts(
    docs: DataFrame,
    support: int = SUPPORT,
    most_words: int = MOST_WORDS,
    shard_bytes: int = SHARD_BYTES,
    trie_phrases: int = TRIE_PHRASES,
) -> tuple[DataFrame, DataFrame]:
    """(counts, totals): all phrases of up to ``most_words`` words with ``support`` occurrences in their language, with exact counts, and each language's words.

    ``docs`` has the columns lang and text, neither null.
    """
    sizes = F.sum(F.octet_length("text")).alias("bytes")
    words = F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0d.,;:!?]+')")
    totals = write_scratch(docs.groupBy("lang").agg(F.sum(words).cast("long").alias("total"), sizes), "phrase-totals")
    known = {r["lang"]: r["total"] for r in totals.where(F.col("total") >= support).orderBy(F.desc("total"), "lang").limit(KNOWN_LANGUAGES).collect()}
    # Many small partitions would be as many small shards: they are read together, as long as all cores have work.
    size = totals.agg(F.sum("bytes")).first()[0] or 0
    shards = max(2 * docs.sparkSession.sparkContext.defaultParallelism, size // shard_bytes)
    if docs.rdd.getNumPartitions() > shards:
        docs = docs.coalesce(shards)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    # With so many shards the local support falls to two and then to one, where shards name nearly all their phrases: first it is found which ones are possible.
    hashes = _possible(docs, support, most_words, shard_bytes, buckets, trie_phrases) if size // shard_bytes >= support // 2 else None
    mined = write_scratch(_mined(docs, known, support, most_words, shard_bytes, buckets, hashes), "phrase-shards")
    slack = {r["lang"]: r["slack"] for r in mined.where("m = 0 and slack > 0").groupBy("lang").agg(F.sum("slack").alias("slack")).collect()}
    candidates = write_scratch(_united(mined, slack, support, buckets), "phrase-candidates")
    drop_scratch(mined)
    found = candidates.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0)).alias("bytes"), F.coalesce(F.max("unknown"), F.lit(0)).alias("unknown")).first()
    if found["unknown"] == 0:
        counts = candidates.select("lang", "m", "phrase", "n")
    elif found["n"] <= trie_phrases and found["bytes"] <= TRIE_BYTES:
        counts = _counted(docs, candidates, shard_bytes)
    else:
        every = _mined(docs, None, support, most_words, shard_bytes, buckets, hashes)
        counts = _united(every, {}, support, buckets).select("lang", "m", "phrase", "n")
    return write_scratch(counts.where(F.col("n") >= support), "phrase-counts"), totals


def collocations(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    support: int = SUPPORT,
    most_words: int = MOST_WORDS,
    top: int = TOP,
    covered: int = 100,
    shard_bytes: int = SHARD_BYTES,
    trie_phrases: int = TRIE_PHRASES,
) -> DataFrame:
    """Each language's ``top`` phrases by how far their words attract each other.

    A-Z are lower-cased; pieces end at ``. , ; : ! ?`` and line ends, words at spaces and tabs. A candidate is a
    phrase of 2 to ``most_words`` words with a >= ``support`` occurrences. A cut after its first k words gives l and r, the
    occurrences of both parts, and floor(1000 * a * n / (l * r)), with n the language's words; the lowest cut counts, ties to the
    smallest k. A candidate inside a longer one with 100 * f(longer) >= ``covered`` * a is dropped.

    Returns (lang, rank, phrase, a, l, r, n, score). A null language is ``und``, a null text empty. Repeated
    rows count as often as they stand there. An empty table gives an empty result; other columns are ignored. Ties in
    the order go to the larger a, then to the smaller phrase in byte order.
    """
    docs = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts, totals = phrase_counts(docs, support, most_words, shard_bytes, trie_phrases)
    long = counts.where("m > 1").withColumn("words", F.split("phrase", " "))
    part = lambda lo, n: F.array_join(F.slice("words", lo, n), " ")
    k = F.col("k")
    cuts = long.select("lang", "m", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.withColumn("left", part(F.lit(1), k)).withColumn("right", part(k + 1, F.col("m") - k)).drop("words")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]).join(totals.select("lang", "total"), "lang")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(38,0)") * wide("a") * wide("total"), wide("l") * wide("r"))
    lowest = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Every phrase inside a longer one, with the longer one's count.
    spans = [(lo, n) for n in range(2, most_words) for lo in range(1, most_words - n + 2)]
    inner = long.where("m > 2").select("lang", F.col("n").alias("longer"), F.explode(F.array_distinct(F.filter(F.array(*[F.when((F.lit(lo + n - 1) <= F.col("m")) & (F.lit(n) < F.col("m")), part(F.lit(lo), F.lit(n))) for lo, n in spans]), lambda x: x.isNotNull()))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = lowest.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(covered) * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = held.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    ranked = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of each language of all documents."""
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with pieces as (
  select doc, lang, p.i as piece, p.s as s from (
    select row_number() over () as doc, coalesce(lang, 'und') as lang,
      unnest(list_transform(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0a-\x0d]'), lambda s, i: {'i': i, 's': s})) as p
    from documents)),
words as (
  select doc, lang, piece, unnest(regexp_extract_all(s, '[^\x20\x09]+')) as w, generate_subscripts(regexp_extract_all(s, '[^\x20\x09]+'), 1) as pos from pieces),
led as (
  select lang, w as w1, lead(w, 1) over p as w2, lead(w, 2) over p as w3, lead(w, 3) over p as w4, lead(w, 4) over p as w5
  from words window p as (partition by doc, piece order by pos)),
grams as (
  select lang, 1 as m, w1 as phrase from led
  union all select lang, 2, w1 || ' ' || w2 from led where w2 is not null
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3 from led where w3 is not null
  union all select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 from led where w4 is not null
  union all select lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 from led where w5 is not null),
f as (select lang, m, phrase, count(*) as n from grams group by all having count(*) >= 100),
totals as (select lang, count(*) as n from words group by lang),
cuts as (
  select c.lang, c.phrase, c.n as a, k, l.n as l, r.n as r, t.n as n, (1000::hugeint * c.n * t.n) // (l.n::hugeint * r.n) as score
  from (select *, string_split(phrase, ' ') as ws, unnest(range(1, m)) as k from f where m > 1) c
  join f l on l.lang = c.lang and l.phrase = array_to_string(ws[1:k], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(ws[k + 1:c.m], ' ')
  join totals t on t.lang = c.lang),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
kept as (
  select * from lowest c where not exists (
    select 1 from f g where g.lang = c.lang and g.m > len(string_split(c.phrase, ' ')) and contains(' ' || g.phrase || ' ', ' ' || c.phrase || ' ') and 100 * g.n >= 100 * c.a))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, cast(score as bigint) as score
from kept qualify rank <= 2000
"""
