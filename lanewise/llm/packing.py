"""Mixture-controlled packing of documents into sequences.

Each source is a queue of tokens. Deficit round-robin serves the queues window by
window: in every window a queue earns its quantum (window tokens x its target share)
and sends whole tokens up to its balance; what is left over, less than a token, is its
deficit and is carried to the next window. As all queues are known to hold enough,
the balance after w windows has a closed form, ``w * quantum - floor(w * quantum)``, and
so the window and place of any token follow from its number in its queue alone. No
task waits for another: deficits are carried over windows, files and partitions by
arithmetic.

When a queue runs dry, a new phase begins at the next window: the remaining queues
share the windows in the proportion of their targets. There are as many phases as
queues at most. With the default targets, the sources' own shares, all queues end
together in the first phase.

The windows are laid end to end and cut into sequences, so only the last sequence of
all is padded.

Tokens are computed once and written as a table in the shared folder, each row with
the number of its source's tokens before it in its own task. Totals by task and source
then give every document's place in its queue; that small table meets the tokens by a
join, as a broadcast only below a checked number of rows.
"""

from __future__ import annotations

import base64
import functools
import itertools
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lanewise.llm.common import read_table, write_scratch

SEQUENCE_TOKENS = 1_024
WINDOW_TOKENS = 64 * SEQUENCE_TOKENS
#: Rows of the table of places that may be broadcast.
BROADCAST_ROWS = 200_000
#: Tokens of a window for each queue, on average, at least: windows grow with the number of sources.
QUEUE_TOKENS = 64
#: Numbers of windows that a task keeps at hand.
KEPT_NUMBERS = 4_000_000
SEPARATOR = 0


class Encoder:
    """Whole texts to ids of a byte-level BPE vocabulary; the vocabulary's special tokens are recognised in texts.

    ``path`` is a file of the tokenizers library (.json). ``ranks`` may name a tiktoken file
    of the same vocabulary, which gives the same ids in about half the time; texts that
    it can't split (runs of about a million spaces) go through the first file.
    """

    def __init__(self, path: str, ranks: str | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.fast = None
        if ranks is not None:
            special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                pass
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def shared_encoder(path: str, ranks: str | None) -> Encoder:
    """One encoder for all tasks that a Python process runs."""
    return Encoder(path, ranks)


class Schedule:
    """Where the t-th token of each queue goes, by deficit round-robin.

    ``totals`` are the queues' tokens, ``targets`` their wanted proportions.
    """

    def __init__(self, totals: list[int], targets: list[Fraction], window: int = WINDOW_TOKENS):
        self.window = window
        self.phases: list[dict] = []
        self._windows: dict[tuple[int, int], list[int]] = {}
        left, first = list(totals), 0
        taken = [0] * len(totals)
        base = 0  # tokens laid before this phase
        while any(left):
            live = [q for q in range(len(totals)) if left[q] and targets[q] > 0] or [q for q in range(len(totals)) if left[q]]
            weight = {q: targets[q] if targets[q] > 0 else Fraction(1) for q in live}
            whole = sum(weight.values())
            quantum = {q: window * weight[q] / whole for q in live}
            # The phase ends with the window in which the first queue runs dry.
            windows = min(-(-left[q] * quantum[q].denominator // quantum[q].numerator) for q in live)
            sent = {q: min(left[q], int(windows * quantum[q])) for q in live}
            self.phases.append({"windows": windows, "base": base, "first": first, "live": live, "quantum": quantum, "taken": list(taken), "sent": sent, "place": {q: i for i, q in enumerate(live)}})
            for q in live:
                taken[q] += sent[q]
                left[q] -= sent[q]
            base += sum(sent.values())
            first += windows

    def runs(self, queue: int, start: int, count: int) -> Iterator[tuple[int, int, int]]:
        """(offset in the request, place in the laid tokens, length) for tokens of a queue, in order."""
        at, end = start, start + count
        for k, ph in enumerate(self.phases):
            if queue not in ph["quantum"]:
                continue
            lo, quantum = ph["taken"][queue], ph["quantum"][queue]
            hi = lo + ph["sent"][queue]
            while lo <= at < hi and at < end:
                t = at - lo
                # The window w with floor(w * quantum) <= t < floor((w + 1) * quantum).
                w = -(-(t + 1) * quantum.denominator // quantum.numerator) - 1
                stop = min(hi - lo, int((w + 1) * quantum)) if w + 1 < ph["windows"] else hi - lo
                before = self._window(k, w)[ph["place"][queue]]
                length = min(stop - t, end - at)
                yield at - start, ph["base"] + before + t - min(hi - lo, int(w * quantum)), length
                at += length

    def _window(self, k: int, w: int) -> list[int]:
        """Tokens of a phase laid before each live queue's part of its window w."""
        if (k, w) not in self._windows:
            if len(self._windows) >= 512:
                self._windows.clear()
            ph = self.phases[k]
            last = w + 1 >= ph["windows"]
            here = [min(ph["sent"][q], int(w * ph["quantum"][q])) for q in ph["live"]]
            until = [ph["sent"][q] if last else min(ph["sent"][q], int((w + 1) * ph["quantum"][q])) for q in ph["live"]]
            self._windows[k, w] = list(itertools.accumulate((b - a for a, b in zip(here, until, strict=True)), initial=sum(here)))
        return self._windows[k, w]


class Shares:
    """As :class:`Schedule` where the targets are the queues' own shares: all queues end together, in one phase.

    Everything follows from ``totals``: queue q has sent ``w * window * totals[q] // tokens`` tokens
    before window w. The sums over all queues that a window needs are one vector operation, so thousands of queues cost little.
    """

    def __init__(self, totals: list[int], window: int = WINDOW_TOKENS):
        self.totals, self.window, self.tokens = totals, max(window, QUEUE_TOKENS * len(totals)), sum(totals)
        self.windows = -(-self.tokens // self.window)
        self._each = np.array(totals, object)
        self._before: dict[int, np.ndarray] = {}

    def sent(self, queue: int, w: int) -> int:
        return self.totals[queue] if w >= self.windows else w * self.window * self.totals[queue] // self.tokens

    def runs(self, queue: int, start: int, count: int) -> Iterator[tuple[int, int, int]]:
        """(offset in the request, place in the laid tokens, length) for tokens of a queue, in order."""
        at, end = start, start + count
        while at < end:
            # The window w with sent(w) <= at < sent(w + 1).
            w = ((at + 1) * self.tokens - 1) // (self.window * self.totals[queue])
            length = min(self.sent(queue, w + 1), end) - at
            yield at - start, int(self._laid(w)[queue]) + at - self.sent(queue, w), length
            at += length

    def _laid(self, w: int) -> np.ndarray:
        """Tokens laid before each queue's part of window w."""
        if w not in self._before:
            if len(self._before) * len(self.totals) >= KEPT_NUMBERS:
                self._before.clear()
            here, until = (self._each if v >= self.windows else v * self.window * self._each // self.tokens for v in (w, w + 1))
            part = (until - here).astype(np.int64)
            self._before[w] = int(here.sum()) + np.cumsum(part) - part
        return self._before[w]


def _tokens(docs: DataFrame, tokenizer_path: str, ranks: str | None) -> DataFrame:
    """(doc_id, source, part, before, n, ids): ids as unsigned 16-bit numbers where they fit, else 32-bit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer_path, ranks)
        kind = np.dtype("<u2") if encoder.size <= 1 << 16 else np.dtype("<u4")
        part, before = TaskContext.get().partitionId(), {}
        for b in batches:
            sources = b["source"].to_pylist()
            ids = [np.append(encoder.encode(t or ""), SEPARATOR).astype(kind) for t in b["text"].to_pylist()]
            counts, lead = [len(x) for x in ids], []
            for source, n in zip(sources, counts, strict=True):
                lead.append(before.get(source, 0))
                before[source] = lead[-1] + n
            ids = [x.tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["source"], pa.array([part] * b.num_rows, pa.int32()), pa.array(lead, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "part", "before", "n", "ids"]
            )

    return docs.mapInArrow(work, "doc_id long, source string, part int, before long, n long, ids binary")


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    targets: dict[str, float] | None = None,
    sequence: int = SEQUENCE_TOKENS,
    window: int = WINDOW_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces of documents in sequences of ``sequence`` tokens.

    The default vocabulary is byte_bpe_50k; its two files give the same ids.

    Returns (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source,
    ids): ids as little-endian unsigned 32-bit numbers. A document's ids end with id 0;
    null or empty texts are that id alone. ``targets`` maps sources to wanted proportions
    of every window, and each of these sources has a queue; the sources that it leaves out
    come, as one queue, after the others have run dry. Without targets the proportions are
    the sources' own shares, every source has a queue, and a window has QUEUE_TOKENS tokens for each
    of them at least; one row for each source goes through the driver. A null source
    is the source ``''``, rows that repeat an id or a text are documents of their own, an
    empty table gives an empty result, and other columns are ignored.
    """
    spark = docs.sparkSession
    source = F.coalesce(F.col(source_col), F.lit(""))
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken") if tokenizer_path is None else None
    named = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), F.col(text_col).alias("text"))
    tokens = write_scratch(_tokens(named, tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), ranks), "pack-tokens")
    by_part = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    totals = by_part.groupBy("source").agg(F.sum("n").alias("n"))
    if targets is None:
        own = totals.orderBy(F.desc("n"), "source").collect()
    else:
        wanted = spark.createDataFrame([(s,) for s in targets], "source string")
        own = totals.join(wanted, "source", "left_semi").orderBy(F.desc("n"), "source").collect()
    all_tokens = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    queues = {r["source"]: i for i, r in enumerate(own)}
    counts = [r["n"] for r in own]
    if (rest := all_tokens - sum(counts)) > 0:
        counts.append(rest)
    want = [] if targets is None else [Fraction(targets[s]).limit_denominator(10**6) for s in queues] + [Fraction(0)] * (len(counts) - len(queues))
    # Places in the queue: sums over tasks, then over sources that share the last queue.
    number = spark.createDataFrame(list(queues.items()), "source string, queue int")
    in_source = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    places = by_part.join(number, "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(queues)))).withColumn("base", F.coalesce(F.sum("n").over(in_source), F.lit(0)))
    places = write_scratch(places.select("source", "part", "queue", "base"), "pack-places")
    few = places.count() <= BROADCAST_ROWS
    placed = tokens.join(F.broadcast(places) if few else places, ["source", "part"]).select("doc_id", "source", "queue", (F.col("base") + F.col("before")).alias("first"), "n", "ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Shares(counts, window) if targets is None else Schedule(counts, want, window)
        for b in batches:
            rows: list[tuple] = []
            for doc, name, queue, first, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes()
                for offset, place, length in schedule.runs(queue, first, n):
                    while length:
                        seq, at = divmod(place, sequence)
                        m = min(length, sequence - at)
                        part = wide[4 * offset : 4 * (offset + m)]
                        rows.append((doc, offset, m, zlib.crc32(part), n, seq, at, name, part))
                        offset, place, length = offset + m, place + m, length - m
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return placed.mapInArrow(work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary")


_PIECES = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], ("source", pa.string()), ("ids", pa.binary())])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents in the proportion of their sources; one row for each piece."""
    return pack(read_table(spark, sf_dir, "documents")).drop("ids", "source")
