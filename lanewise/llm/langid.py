"""Language identification by compression.

A language's model is a raw-content zstandard dictionary: text of that language. A
document's distinct words are encoded with each language's dictionary, in blocks, and the
language whose dictionary gives the fewest bytes wins. The margin, in bytes saved against the
runner-up for each byte of the best encoding, says how sure that is. Narrow margins are
rejected: labelled rows beside those of the dictionaries say, for short, middle and long
texts apart, how wide margins of right answers are. A margin must be at least half of the
one that all but a share of NARROWEST of these reach: invented words and languages that
weren't learned have far narrower ones.

Dictionaries and margins are fitted on a bounded sample of labelled rows. They are a few
hundred kilobytes for each language and are the only thing that tasks share; documents are
encoded where they are read, without a shuffle.
"""

from __future__ import annotations

import math
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import read_table, write_scratch

#: Of the fitting sample, for each language: rows of the dictionary and of the margins.
SAMPLE_ROWS, MARGIN_ROWS = 400, 2_000
#: Share of right answers whose margins may be narrower than twice the least accepted; bytes of distinct words from which on a text is a middle and a long one; least margin accepted.
NARROWEST, LENGTHS, LEAST_MARGIN = 0.001, (64, 512), 0.02
#: Bytes of a dictionary and of the blocks that a text is encoded in; zstandard's level.
DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 60_000, 512, 12
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: str) -> list[str]:
    """The distinct words of a whole text, letters and their combining marks, in lower case, in order of their first place.

    What a text repeats says nothing more about its language, but would be encoded from
    the text itself instead of the dictionary.
    """
    return list(dict.fromkeys(_WORD.findall(text.lower())))


@dataclass(frozen=True)
class Fitted:
    """A dictionary for each language, and the widest margin that is rejected for short, middle and long texts."""

    dictionaries: dict[str, bytes]
    narrow: tuple[float, ...] = (LEAST_MARGIN,) * (len(LENGTHS) + 1)


class Model:
    """Dictionaries by language, ready to encode; made anew in each task."""

    def __init__(self, fitted: Fitted):
        self.languages, self.narrow = sorted(fitted.dictionaries), fitted.narrow
        self.encoders = []
        for lang in self.languages:
            made = zstandard.ZstdCompressionDict(fitted.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

    def _sizes(self, blocks: list[bytes]) -> list[int]:
        return [sum(map(len, map(e.compress, blocks))) for e in self.encoders]

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected). Ties are encoded again word by word, which is finer."""
        found = words(text) if text and self.languages else []
        if not found:
            return UNKNOWN, 0.0, 0.0, True
        raw = " ".join(found).encode("utf-8", "replace")
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        sizes = self._sizes(blocks)
        if len(sizes) > 1 and sorted(sizes)[0] == sorted(sizes)[1]:
            least = min(sizes)
            finer = self._sizes([f" {w} ".encode("utf-8", "replace") for w in found])
            sizes = [f if s == least else f + max(finer) for s, f in zip(sizes, finer, strict=True)]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], self.languages[i]))
        best = sizes[order[0]]
        # Of one language alone the runner-up is the encoding without a dictionary.
        second = sizes[order[1]] if len(order) > 1 else sum(len(self.plain.compress(b)) for b in blocks)
        margin = (second - best) / best
        # The score is a logistic of the bytes saved against the runner-up: 0.5 at a tie.
        return self.languages[order[0]], 1 / (1 + math.exp(-max(-50, min(second - best, 50)) / 4)), margin, margin <= self.narrow[bisect(LENGTHS, len(raw))]


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", seed: int = 5) -> Fitted:
    """A dictionary for each language of ``labelled``, and the margins to reject.

    The sample's rows are the first by a hash of their id and text: SAMPLE_ROWS for each
    language, whose distinct words are joined to DICTIONARY_BYTES at most, then MARGIN_ROWS
    for the margins. Rows without a language or without letters take no part.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    rows = rows.select(F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.lit(seed), id_col, text_col), F.lit(1 << 30)).alias("h"), F.col(text_col).alias("text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # Each language is thinned by the hash to about twice the rows wanted, so that its ranking stays small however large the table.
    wanted = SAMPLE_ROWS + MARGIN_ROWS
    rate = counts.select("lang", (F.lit(2.0 * wanted) / F.col("n") * (1 << 30)).alias("most"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = rows.join(F.broadcast(rate), "lang").where("h < most").withColumn("r", order).where(F.col("r") <= wanted).select("lang", "r", "text")
    sample = write_scratch(sample, "language-sample")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row's words, no more than a dictionary takes."""
        for b in batches:
            short = [" ".join([*words(t), ""]).encode("utf-8", "replace")[:DICTIONARY_BYTES] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["lang"], b["r"], pa.array(short, pa.binary())], ["lang", "r", "words"])

    dictionaries: dict[str, bytes] = {}
    short = sample.where(F.col("r") <= SAMPLE_ROWS).mapInArrow(shorten, "lang string, r int, words binary")
    before = F.coalesce(F.sum(F.length("words")).over(Window.partitionBy("lang").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    for row in short.where("length(words) > 0").withColumn("at", before).where(F.col("at") < DICTIONARY_BYTES).orderBy("lang", "r").toLocalIterator():
        dictionaries[row["lang"]] = (dictionaries.get(row["lang"], b"") + bytes(row["words"]))[:DICTIONARY_BYTES]
    if not dictionaries:
        return Fitted({})
    shared = labelled.sparkSession.sparkContext.broadcast(Fitted(dictionaries))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for b in batches:
            out = [(bisect(LENGTHS, len(" ".join(words(t)).encode("utf-8", "replace"))), m) for lang, t in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True) for said, _, m, _ in (model.predict(t),) if said == lang]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.float64())], ["length", "margin"])

    right = sample.where(F.col("r") > SAMPLE_ROWS).mapInArrow(weigh, "length int, margin double").toArrow()
    length, margin = right["length"].to_numpy(), right["margin"].to_numpy()
    narrow = []
    for k in range(len(LENGTHS) + 1):
        mine = np.sort(margin[length == k])
        narrow.append(max(LEAST_MARGIN, float(mine[int(NARROWEST * len(mine))]) / 2 if len(mine) else 0.0))
    return Fitted(dictionaries, tuple(narrow))


def predict(docs: DataFrame, fitted: Fitted, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, margin and rejected.

    lang_pred is one of the fitted languages, ``und`` for texts that are null or hold no
    letter (score and margin 0, rejected); ties go to the first language by name. Texts are
    never cut short. Columns called like the four new ones are replaced, all others stay.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fitted)
    new = {"lang_pred": (T.StringType(), pa.string()), "score": (T.DoubleType(), pa.float64()), "margin": (T.DoubleType(), pa.float64()), "rejected": (T.BooleanType(), pa.bool_())}
    docs = docs.drop(*new)
    schema = T.StructType([*docs.schema, *[T.StructField(name, kind) for name, (kind, _) in new.items()]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for b in batches:
            said = [model.predict(t) for t in b[text_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([s[i] for s in said], kind) for i, (_, kind) in enumerate(new.values())]], [*b.schema.names, *new])

    return docs.mapInArrow(work, schema)


def held_out():
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labelled documents that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    said = predict(docs.select("doc_id", "text"), fit(docs.where(~held_out())))
    return said.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, training: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with their columns unchanged."""
    return predict(docs, fit(training)).where("not rejected").select(*docs.columns)
