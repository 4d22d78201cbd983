"""Helpers shared by the operators of this subpackage: reading tables, scratch tables, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder; any store that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors are one process, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    fallback = "file://" + tempfile.mkdtemp(prefix="lanewise-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a rereading, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop_scratch(df: DataFrame) -> None:
    """Delete a table of :func:`write_scratch` that nothing lazy refers to any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


# --- word hashing -----------------------------------------------------------
# A text's words are hashed all at once from its UTF-8 bytes: a prefix sum of
# table[byte] * R**position gives each word's polynomial in one subtraction, and
# multiplying by R**-start makes it independent of the place in the text.

_R = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i below n, grown by doubling and kept."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for slot, base in enumerate((_R, pow(_R, -1, 2**64))):
            out = np.ones(size, np.uint64)
            filled = 1
            while filled < size:
                out[filled : 2 * filled] = out[:filled] * np.uint64(pow(base, filled, 2**64))
                filled *= 2
            _powers[slot] = out
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1 of all i, in order."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    up, down = _power_tables(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts]) if len(starts) else np.empty(0, np.uint64)


def word_hashes(raw: bytes, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the maximal runs of bytes that ``space`` doesn't mark."""
    buf = np.frombuffer(raw, np.uint8)
    if not len(buf):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~space[buf]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_hashes(buf, starts, ends), starts, ends


def word_groups(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Hash the ASCII-lower-cased words of many whole texts, about ``limit`` bytes at a time.

    Yields (first, last, hashes, offsets): text ``first + i`` has the words
    ``hashes[offsets[i]:offsets[i + 1]]``. Texts are never cut.
    """
    first = 0
    while first < len(texts):
        parts, size, last = [], 0, first
        while last < len(texts) and (not parts or size < limit):
            raw = (texts[last] or "").encode("utf-8", "surrogatepass").lower()
            parts.append(raw)
            size += len(raw) + 1
            last += 1
        hashes, starts, _ = word_hashes(b" ".join(parts))
        bounds = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        yield first, last, hashes, np.searchsorted(starts, bounds)
        first = last


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct hashes of runs of ``words`` words, and their offsets.

    A text with fewer words has its whole sequence as its one shingle; a text
    without words has none.
    """
    n = len(offsets) - 1
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(n), counts)
    place = np.arange(len(hashes)) - offsets[:-1].repeat(counts)
    full = place + words <= counts[owner] if len(hashes) else np.empty(0, bool)
    at = np.flatnonzero(full)
    value = np.zeros(len(at), np.uint64)
    for i in range(words):
        value = mix64(value * np.uint64(0xD6E8FEB86659FD93) + hashes[at + i] + np.uint64(i + 1))
    rows = owner[at]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for j, i in enumerate(short):
            whole = hashes[offsets[i] : offsets[i + 1]]
            acc = np.zeros(1, np.uint64)
            for w in range(len(whole)):
                acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + whole[w : w + 1] + np.uint64(w + 1))
            extra[j] = mix64(acc + np.uint64(len(whole) * 0xA24BAED4963EE407 % 2**64))[0]
        value, rows = np.concatenate([value, extra]), np.concatenate([rows, short])
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    if len(value):
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
        value, rows = value[keep], rows[keep]
    return value, np.searchsorted(rows, np.arange(n + 1))
