"""Secret scans with an incremental ledger of blobs.

Every version of a file is addressed by its content: a path is (id, blob), a blob is
the SHA-256 of the text. A ledger holds, for each blob and rule version, what that
rule found. A scan joins the distinct blobs against the ledger, runs only the rules
that a blob has not met in their present version, adds the outcome to the ledger and
joins the ledger back to all paths. Copies, renamed files and old versions are
scanned once; raising a rule's version rescans for that rule alone. What a scan finds is
written once, as a table in the shared folder, and both the findings and the ledger read it.

Spark keeps the text of one path for each blob (the group limit acts before the
shuffle, so a blob that a third of all paths hold is cut down in each task) and
shuffles it once by blob; findings are small.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import read_table, write_scratch


@dataclass(frozen=True)
class Rule:
    """A pattern; ``hints``, of which a text in lower case must hold one, save the search elsewhere."""

    kind: str
    version: int
    pattern: str
    least: int = 0  # characters that the match, or ``group`` of it, must have
    group: int = 0
    hints: tuple[str, ...] = ()
    flags: int = 0


#: Kinds in the order in which equal starts are listed, and their patterns.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, ("passw", "secret", "token", "api"), re.I | re.A),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20, hints=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}"),  # a match of 24 characters or more begins where its run does
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", hints=("private key-----",)),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("prefixed", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", hints=("gho_", "ghp_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "aiza")),
    Rule("bearer", 1, r"\b[Bb]earer\x20+([A-Za-z0-9+/_.=-]{16,})", hints=("bearer",)),
    Rule("url", 1, r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@", hints=("://",)),
)
BASE = ("assign", "access", "hex")


def find(rule: Rule, text: str, lower: str, compiled: re.Pattern) -> list[tuple[int, int]]:
    """Spans of one rule, in code points, leftmost and without overlaps."""
    if rule.hints and not any(h in lower for h in rule.hints):
        return []
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan_secrets(
    paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(found, ledger): findings of every path, and the ledger with this scan's blobs added.

    ``found`` has (doc_id, blob, findings array of (kind, start, end)) with one row for
    each row of ``paths``; ``ledger`` has (blob, kind, version, findings) and can be
    stored and given to the next scan. Null texts are empty, repeated rows are paths of
    their own, null ids stay, an empty table gives empty tables; other columns are
    ignored. A ledger row of an older rule version is never used or altered.
    """
    spark = paths.sparkSession
    source = paths.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumn("blob", F.sha2("text", 256))
    first = Window.partitionBy("blob").orderBy("doc_id")
    blobs = source.withColumn("place", F.row_number().over(first)).where("place = 1").select("blob", "text")
    if ledger is not None:
        current = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
        met = ledger.join(F.broadcast(current), ["kind", "version"], "left_semi").groupBy("blob").agg(F.collect_set("kind").alias("met"))
        blobs = blobs.join(met, "blob", "left").where(F.coalesce(F.size("met"), F.lit(0)) < len(rules))
    else:
        blobs = blobs.withColumn("met", F.array().cast("array<string>"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern, r.flags) for r in rules]
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            out, new = [], []
            for text, met in zip(b["text"].to_pylist(), b["met"].to_pylist(), strict=True):
                lower, met = text.lower(), set(met or ())
                out.append([{"kind": r.kind, "version": r.version, "start": s, "end": e} for r, c in zip(rules, compiled, strict=True) if r.kind not in met for s, e in find(r, text, lower, c)])
                new.append([r.kind for r in rules if r.kind not in met])
            yield pa.RecordBatch.from_arrays([b["blob"], pa.array(out, kinds), pa.array(new, pa.list_(pa.string()))], ["blob", "hits", "scanned"])

    scanned = write_scratch(blobs.mapInArrow(work, "blob string, hits array<struct<kind: string, version: int, start: int, end: int>>, scanned array<string>"), "secrets-scanned")
    versions = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    added = scanned.select("blob", "hits", F.explode("scanned").alias("kind")).select(
        "blob", "kind", F.element_at(versions, F.col("kind")).alias("version"),
        F.transform(F.filter("hits", lambda h: h["kind"] == F.col("kind")), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))).alias("findings"),
    )
    slim = scanned.select("blob", F.transform("hits", lambda h: F.struct(h["kind"].alias("kind"), h["start"].alias("start"), h["end"].alias("end"))).alias("findings"))
    if ledger is not None:
        old = ledger.join(F.broadcast(current), ["kind", "version"], "left_semi").select("blob", F.transform("findings", lambda h: F.struct(F.col("kind"), h["start"].alias("start"), h["end"].alias("end"))).alias("findings"))
        slim = slim.unionByName(old).groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
        added = ledger.unionByName(added)
    # Only blobs with findings meet the paths, so the join's small side stays small and a hot blob's paths are all on the large side.
    found = source.select("doc_id", "blob").join(slim.where(F.size("findings") > 0), "blob", "left")
    return found.withColumn("findings", F.coalesce("findings", F.array().cast("array<struct<kind:string,start:int,end:int>>"))), added


def digest(found: DataFrame, kinds: tuple[str, ...], base: tuple[str, ...] = BASE, is_base=None) -> DataFrame:
    """Counts, the base spans' SHA-256 and all spans as text, for rows of (doc_id, findings).

    Spans are listed by start, then by kind in the order of ``kinds``, then by end. Base
    spans are those for which ``is_base`` holds, or else those of the kinds ``base``.
    """
    order = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    is_base = is_base or (lambda x: x["kind"].isin(*base))
    listed = lambda x: F.struct(x["start"].alias("start"), F.element_at(order, x["kind"]).alias("o"), x["end"].alias("end"), x["kind"].alias("kind"), is_base(x).alias("base"))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of_kind = lambda k: lambda x: x["base"] & (x["kind"] == k)
    out = found.withColumn("listed", F.array_sort(F.transform("findings", listed)))
    return out.select(
        "doc_id",
        *[F.size(F.filter("listed", of_kind(k))).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(text(F.filter("listed", lambda x: x["base"])), 256).alias("base_sha256"),
        text(F.col("listed")).alias("spans"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan all documents as two batches over one ledger, the second of which scans only what the first hasn't met; one row for each document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    middle = F.lit(docs.agg(((F.min("doc_id") + F.max("doc_id")) / 2).alias("m")).first()["m"])
    early = F.coalesce(F.col("doc_id") <= middle, F.lit(True))
    first, ledger = scan_secrets(docs.where(early))
    second, _ = scan_secrets(docs.where(~early), ledger)
    return digest(first.unionByName(second), tuple(r.kind for r in RULES))


def brute_force(text: str | None) -> tuple[list[tuple[str, int, int]], str]:
    """A document's base spans and their digest by the plain definition; for tests."""
    text = text or ""
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, "assign", m.end()))
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    spans.sort()
    return [(k, s, e) for s, _, k, e in spans], hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans).encode()).hexdigest()
