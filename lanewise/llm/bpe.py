"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

*Words.* A text's words are the matches of the vocabulary's pattern. How a word is
encoded depends on the word alone, so each distinct word is encoded once for many texts.

*Replay.* The distinct words lie end to end in one array of tokens. An inverted index
holds, for each rank, the positions at which a pair of neighbours merges into it. Ranks are
taken in rising order; all positions of a rank are merged at once, and only their left and
right neighbours get new pairs and new entries in the index. A word whose new pair has a
lower rank than the one at hand (vocabularies that weren't trained by merges in this order
can have such pairs) leaves the replay and is encoded alone, merge by merge.

*Corpus.* Words are counted over the whole corpus, added up within tasks before the
shuffle. The most frequent, as many as SHARED_WORDS, are replayed once, dealt over tasks by
hash; their ids are of bounded size and go to every task that encodes texts. All other words
are replayed in the group of texts in which they occur, with the same index, so the result
doesn't depend on what is shared, and the corpus's long tail of words is neither shuffled
nor held in memory.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import drop_scratch, read_table, spread, write_scratch

#: Words that all tasks share, at most; their bytes are bounded by SHARED_BYTES for each.
SHARED_WORDS, SHARED_BYTES = 1 << 18, 64
#: Characters of the texts that are encoded together, and words that are replayed together, at most (but for single longer texts and words).
GROUP_CHARS, REPLAY_BYTES = 6_000_000, 1_500_000
#: Entries of the tables that a task keeps between groups of texts.
KEPT_WORDS = 250_000
#: Words that a task counts before it hands its counts on.
COUNTED_WORDS = 200_000

_SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A text falls into these chunks, and each chunk into words: no word reaches across.
CHUNK = re.compile(f" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")


def _members(category: str) -> str:
    """The characters of a Unicode category as ranges of a pattern, as the tiktoken library has them."""
    single = tiktoken.Encoding("bytes", pat_str=category, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    code = np.array([ord(c) for c in bytes(single.encode_ordinary(every)).decode()])
    cuts = np.flatnonzero(np.diff(code) != 1) + 1
    return "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in zip(code[np.r_[0, cuts]], code[np.r_[cuts - 1, -1]], strict=True))


@functools.cache
def word_pattern() -> re.Pattern:
    """PATTERN of public_tokenizers for the ``re`` module, with the library's own tables of letters and numbers."""
    pattern = public_tokenizers.PATTERN
    for name, members in (("\\p{L}", _members("\\p{L}")), ("\\p{N}", _members("\\p{N}")), ("\\s", _SPACES)):
        # Inside a class the members stand as they are, outside they are a class; \S is the complement.
        pattern = re.sub(r"\[[^\]]*\]", lambda m, n=name, x=members: m[0].replace(n, x), pattern)
        pattern = pattern.replace(name, f"[{members}]")
    return re.compile(pattern.replace("\\S", f"[^{_SPACES}]"))


class Vocabulary:
    """Ranks of a tiktoken file, all pairs that merge into them, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        known = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    known[a * self.size + b] = rank
        self.pairs = known
        self.codes = np.array(sorted(known), np.int64)
        self.merged = np.array([known[c] for c in self.codes.tolist()], np.int64)
        tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges into, -1 if it doesn't."""
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.merged[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, end to end."""
        return self.flat[spread(self.starts[ids], self.starts[ids + 1] - self.starts[ids])].tobytes()


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for all tasks that a Python process runs."""
    return Vocabulary(path)


def alone(word: bytes, vocab: Vocabulary) -> list[int]:
    """One word's ids: the leftmost pair of the lowest rank merges, until none does."""
    token = vocab.single[np.frombuffer(word, np.uint8)].tolist()
    n = len(token)
    after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
    pair = lambda i: vocab.pairs.get(token[i] * vocab.size + token[after[i]], -1) if after[i] >= 0 else -1
    now = [pair(i) for i in range(n)]
    heap = [(r, i) for i, r in enumerate(now) if r >= 0]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        if now[i] != rank:
            continue
        j = after[i]
        token[i], after[i], now[j] = rank, after[j], -2
        if after[j] >= 0:
            before[after[j]] = i
        for at in (i, before[i]):
            if at >= 0:
                now[at] = pair(at)
                if now[at] >= 0:
                    heapq.heappush(heap, (now[at], at))
    return [t for t, r in zip(token, now, strict=True) if r != -2]


def replay(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words end to end, and where each word's begin (with the end of the last).

    A word that is itself in the vocabulary is that one id, as in the tiktoken library.
    """
    whole = np.array([vocab.ranks.get(w, -1) for w in words], np.int64)
    rest = np.flatnonzero(whole < 0)
    lengths = np.array([len(words[i]) for i in rest], np.int64)
    starts = np.cumsum(lengths) - lengths
    token = vocab.single[np.frombuffer(b"".join([words[i] for i in rest]), np.uint8)]
    n = len(token)
    place = np.arange(n, dtype=np.int32)
    after, before = place + 1, place - 1
    after[starts[1:] - 1] = -1
    before[starts] = -1
    after[-1:] = -1
    live = np.ones(n, bool)
    now = np.full(n, -1, np.int32)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []
    odd: dict[int, list[int]] = {}

    def enter(at: np.ndarray) -> None:
        """New pairs at these positions, with entries in the index."""
        at = at[now[at] >= 0]
        at = at[np.argsort(now[at], kind="stable")]
        rank = now[at]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, part in zip(rank[np.r_[0, cuts]].tolist() if len(rank) else (), np.split(at, cuts), strict=False):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(heap, r)

    first = np.flatnonzero(after >= 0)
    now[first] = vocab.rank_of(token[first], token[after[first]])
    enter(first)
    while heap:
        rank = heapq.heappop(heap)
        parts = index.pop(rank)
        at = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        at = at[now[at] == rank]
        if not len(at):
            continue
        # Where positions follow each other, every second one merges, from the left.
        chained = np.r_[False, after[at[:-1]] == at[1:]]
        if chained.any():
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[run % 2 == 0]
        gone = after[at]
        right = after[gone]
        has = right >= 0
        passing = np.zeros(len(at), bool)  # lower ranks that stand for a moment only, while others of this round still wait
        passing[has] = (was := vocab.rank_of(np.full(int(has.sum()), rank), token[right[has]])) < rank
        passing[has] &= was >= 0
        token[at] = rank
        after[at] = right
        before[right[has]] = at[has]
        now[gone] = -1
        live[gone] = False
        left = before[at]
        touched = np.unique(np.concatenate([at, left[left >= 0]]))
        now[touched] = -1
        inner = touched[after[touched] >= 0]
        now[inner] = vocab.rank_of(token[inner], token[after[inner]])
        low = inner[(now[inner] >= 0) & (now[inner] < rank)]
        if len(low) or passing.any():
            for w in np.unique(np.searchsorted(starts, np.concatenate([low, at[passing]]), "right") - 1).tolist():
                odd[w] = alone(words[rest[w]], vocab)
                now[starts[w] : starts[w] + lengths[w]] = -1
        enter(inner)
    # Words that left the replay give their own ids; the others what stands in the array.
    counts = np.add.reduceat(live, starts) if n else np.zeros(0, np.int64)
    ids = token[live]
    size = np.ones(len(words), np.int64)
    size[rest] = counts
    for w, own in odd.items():
        size[rest[w]] = len(own)
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(ends) else 0, np.int32)
    begin = ends - size
    out[begin[whole >= 0]] = whole[whole >= 0]
    taken = np.cumsum(counts) - counts
    plain = np.ones(len(rest), bool)
    plain[list(odd)] = False
    out[spread(begin[rest[plain]], counts[plain])] = ids[spread(taken[plain], counts[plain])]
    for w, own in odd.items():
        out[begin[rest[w]] : ends[rest[w]]] = own
    return out, np.r_[begin, ends[-1:]] if len(ends) else np.zeros(1, np.int64)


def replayed(words: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`replay`, in portions of bounded size."""
    ids, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    raw = [w.encode() for w in words]
    sizes = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    lo = 0
    while lo < len(raw):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + REPLAY_BYTES, "right")))
        part, starts = replay(raw[lo:hi], vocab)
        ids.append(part)
        lengths.append(np.diff(starts))
        lo = hi
    return np.concatenate(ids), np.r_[0, np.cumsum(np.concatenate(lengths))]


@dataclass
class Shared:
    """Words with their ids end to end, and where each word's begin (with the end of the last)."""

    words: list[str] = field(default_factory=list)
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))


class Table:
    """Ids of the chunks that a task has met: a number for each chunk, and its ids."""

    def __init__(self, vocab: Vocabulary, shared: Shared):
        self.vocab, self.shared = vocab, shared
        self.place = dict(zip(shared.words, range(len(shared.words)), strict=True))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def numbers(self, text: str) -> np.ndarray:
        """The chunks of a text as numbers; new ones are only named."""
        chunks = CHUNK.findall(text)
        for c in set(chunks).difference(self.number):
            self.number[c] = len(self.number)
        return np.fromiter(map(self.number.__getitem__, chunks), np.int32, len(chunks))

    def complete(self) -> None:
        """Encode the chunks that have been named since the last time."""
        split = word_pattern().findall
        words, counts = [], []
        for chunk in itertools.islice(self.number, len(self.starts) - 1, None):
            own = split(chunk)
            words += own
            counts.append(len(own))
        first = len(self.shared.words)
        new: dict[str, int] = {}
        known = self.place.get
        at = np.fromiter((new.setdefault(w, first + len(new)) if (i := known(w)) is None else i for w in words), np.int64, len(words))
        ids, starts = replayed(list(new), self.vocab)
        flat = np.concatenate([self.shared.ids, ids])
        begin = np.concatenate([self.shared.starts, self.shared.starts[-1] + starts[1:]])
        sizes = begin[at + 1] - begin[at]
        total = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(np.array(counts, np.int64))]]
        self.ids = np.concatenate([self.ids, flat[spread(begin[at], sizes)]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + total[1:]])

    def encoded(self, numbers: np.ndarray) -> np.ndarray:
        starts = self.starts[numbers]
        return self.ids[spread(starts, self.starts[numbers + 1] - starts)]


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of the words of ``text`` between spaces; runs of white space, and words longer than SHARED_BYTES, are left to the texts that hold them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for piece, n in pieces.items():
                if piece and len(piece) <= SHARED_BYTES:
                    for w in word_pattern().findall(" " + piece):
                        words[w] += n
            pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for text in b["text"].to_pylist():
                if text:
                    pieces.update(text.split(" "))
                    if len(pieces) > COUNTED_WORDS:
                        yield counted()
        yield counted()

    return texts.select("text").mapInArrow(work, "word string, n long").where(F.octet_length("word") <= SHARED_BYTES).groupBy("word").agg(F.sum("n").alias("n"))


def shared_words(texts: DataFrame, path: str, most: int = SHARED_WORDS) -> Shared:
    """Ids of the corpus's most frequent words, replayed on the cluster; ``most`` words at most, none that occurs once only."""
    counts = write_scratch(word_counts(texts), "bpe-words")
    # How many words have each count, by steps of an eighth of a doubling: the lowest step down to which no more than ``most`` words lie.
    step = F.floor(F.log2("n") * 8)
    least, total = None, 0
    for r in counts.where("n > 1").groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        drop_scratch(counts)
        return Shared()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, words = vocabulary(path), []
        for b in batches:
            words += b["word"].to_pylist()
        if words:
            ids, starts = replayed(words, vocab)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids))], ["word", "ids"])

    frequent = counts.where((F.col("n") > 1) & (step >= least)).select("word").repartition("word")
    out = frequent.mapInArrow(work, "word string, ids array<int>").toArrow()
    drop_scratch(counts)
    ids = out["ids"].combine_chunks()
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    sizes = np.diff(ids.offsets.to_numpy()) if len(ids) else np.zeros(0, np.int64)
    return Shared(out["word"].to_pylist(), ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.r_[0, np.cumsum(sizes, dtype=np.int64)])


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", shared: int = SHARED_WORDS, decoded_col: str | None = None) -> DataFrame:
    """``df`` with the ids of each whole text, as an array of ints, in place of the text; ``path`` is a tiktoken file of ranks.

    Equal to tiktoken's ``encode_ordinary`` with public_tokenizers.PATTERN: no special tokens. A null or empty
    text has no ids (an empty array). Rows that repeat are encoded like any other; an
    empty table gives an empty one; other columns stay, one that is named ``ids_col`` is replaced. With ``decoded_col``
    a further column has the bytes that the ids stand for, as :func:`decode` gives them: decoded in the same process, so
    that a task holds one vocabulary and ids don't go back to a second process.
    """
    spark = df.sparkSession
    frequent = shared_words(df.select(F.col(text_col).alias("text")), path, shared) if shared else Shared()
    known = spark.sparkContext.broadcast(frequent)
    rest = df.drop(ids_col, *([decoded_col] if decoded_col else []))
    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(decoded_col, T.BinaryType(), False)] if decoded_col else [])]
    schema = T.StructType([*[f for f in rest.schema.fields if f.name != text_col], *added])
    place = rest.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(vocabulary(path), known.value)
        held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
        chars = 0

        def ready() -> Iterator[pa.RecordBatch]:
            table.complete()
            for b, numbers in held:
                lo, size = 0, 0
                for i, x in enumerate(numbers):  # a batch of ids is bounded too
                    size += len(x)
                    if size >= 500_000 or i + 1 == len(numbers):
                        ids = [table.encoded(y) for y in numbers[lo : i + 1]]
                        offsets = pa.array(np.r_[0, np.cumsum([len(y) for y in ids])], pa.int32())
                        column = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32()))
                        back = [pa.array(map(table.vocab.decode, ids), pa.binary())] if decoded_col else []
                        yield pa.RecordBatch.from_arrays([*b.slice(lo, i + 1 - lo).columns, column, *back], [*b.schema.names, ids_col, *([decoded_col] if back else [])])
                        lo, size = i + 1, 0
            held.clear()
            if len(table.number) > KEPT_WORDS:
                table.clear()

        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                texts, b = b.column(place).to_pylist(), b.drop_columns([text_col])
                held.append((b, [table.numbers(t or "") for t in texts]))
                chars += sum(len(t or "") for t in texts)
                if chars >= GROUP_CHARS:
                    yield from ready()
                    chars = 0
        yield from ready()

    return rest.mapInArrow(work, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that each array of ids stands for; null for null. A column of that name is replaced."""
    rest = df.drop(bytes_col)
    schema = T.StructType([*rest.schema.fields, T.StructField(bytes_col, T.BinaryType(), True)])
    place = rest.columns.index(ids_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            column = b.column(place)
            flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            parts = [vocab.decode(flat[lo:hi]) if column[i].is_valid else None for i, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts, pa.binary())], [*b.schema.names, bytes_col])

    return rest.mapInArrow(work, schema)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to ids and back; digests of the ids and of the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded_col="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
