"""Personal data by candidates, boosted trees and calibrated thresholds.

*Propose.* High-recall generators propose spans of six kinds, which may overlap: the
base patterns' own matches, and looser forms (addresses written around, dotted or
grouped numbers, international account and social security numbers).

*Score.* A candidate's features are its format (digits, groups, separators, checks) and
its context (neighbouring characters, words shortly before). Boosted trees give the
probability that it is personal data.

*Labels* don't come from the base patterns. Loose forms of made-up people are planted into
pieces of sampled documents, led in as people do or not at all, and so are decoys: order
numbers, versions, wrong check sums, an at-sign in a sentence. What the corpus itself holds
is labelled by its content: base matches are positive, and a loose form is if a domain in
use, a digit plan, a telephone cue or a check sum speaks for it.

*Select.* Of held-out documents each kind's candidates that are no base matches, planted ones
and the corpus's own, give the lowest threshold at which what it selects is right
with the wanted precision; a kind that never reaches it selects nothing more. The corpus's
own are all counted, by kind and step of probability, in a pass of their own. Base spans
are always selected, and others that don't overlap them are added.

The sample that trees are fitted on is bounded for each kind, base matches and others apart, so that rare ones are reached.
The model is a few kilobytes; documents are scanned where they are read, whole, and never
shuffled.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.boosting import BoostedTrees
from lanewise.llm.common import read_table
from lanewise.llm.secrets import digest

#: Candidates that the trees may be fitted on of each kind, base matches and others apart; pieces with a planted form or decoy in all, and of one document at most; precision wanted, least held-out candidates selected, least threshold.
SAMPLE_CANDIDATES, PLANTED, PLANTED_EACH, PRECISION, LEAST_SELECTED, LEAST_THRESHOLD = 5_000, 12_000, 50, 0.98, 20, 0.5

#: Steps of probability in which held-out candidates are counted; a power of two, so that a step's ends are exact.
STEPS = 1 << 14
#: Held-out candidates that a task scores at once, about.
SCORED_AT_ONCE = 10_000

#: Kinds in the order in which equal starts are listed, with their base patterns.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = (*BASE, "account", "ssn")
#: Looser generators and the kind that they propose.
LOOSE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{2,64}\s?(?:\(at\)|\[at\]|@)\s?[A-Za-z0-9-]{1,63}\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z]{2,24}"), ("@", "at)", "at]")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+-])(?:\(?0[0-9]{1,4}\)?|\([0-9]{2,4}\)|[0-9]{3})[ ./-]?[0-9]{3,4}[ ./-][0-9]{3,5}(?![0-9A-Za-z])"), None),
    ("card", re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}(?![0-9A-Za-z])"), None),
    ("account", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"), None),
    ("ip", re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\(dot\)|\[dot\])\s?[0-9]{1,3}){3}(?![0-9A-Za-z])"), ("[.", "(.", "dot")),
    ("ssn", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"), ("-",)),
)
CUES = tuple(re.compile(p) for p in (r"mail|contact", r"ip|host|server|addr", r"card|visa|credit|pay", r"tel|phone|call|fax|mobil", r"iban|account|konto", r"ssn|social|security", r"order|part|invoice|ref|serial|version|model|ticket|isbn|item|batch"))
DIGIT = re.compile("[0-9]")
#: Ends of domains that aren't words of a sentence, and national numbers: area code in brackets or after 0, or 3-3-4 digits.
ENDS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "dev", "app", "ai", "eu", "uk", "de", "fr", "es", "ch", "nl", "pl", "se", "jp", "cn", "br", "ru", "au", "ca", "co")
DOMAIN = re.compile(rf"(?:@|\(at\)|\[at\]).*(?:\.|\(dot\)\s?|\[dot\]\s?)(?:{'|'.join(ENDS)})$", re.I)
NATIONAL = re.compile(r"(?:\(?0[1-9][0-9]{0,3}\)?|\([2-9][0-9]{1,3}\))[ ./-]?[0-9]{3,4}[ ./-]?[0-9]{3,5}|\(?[2-9][0-9]{2}\)?[ ./-]?[0-9]{3}[ ./-][0-9]{4}")
#: Words that lead in planted forms of each kind, and decoys.
LEADS = {
    "email": ("email", "mail me at", "contact", "write to"),
    "ip": ("host", "server", "ip address", "from"),
    "card": ("card", "visa", "paid with", "credit card no."),
    "phone": ("phone", "tel.", "call me on", "my number is", "fax"),
    "account": ("iban", "account", "transfer to", "konto"),
    "ssn": ("ssn", "social security number", "my social is"),
}
DECOY_LEADS = ("order", "part", "invoice", "ref.", "serial", "version", "model", "ticket", "item", "batch")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    """The strict check of a kind."""
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in re.findall("[0-9]+", found)))
    digits = "".join(c for c in found if "0" <= c <= "9")
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "account":
        plain = found.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    if kind == "ssn":
        return found[:3] not in ("000", "666") and found[0] != "9" and found[4:6] != "00" and found[7:] != "0000"
    return True


def plausible(text: str, kind: str, start: int, end: int) -> bool:
    """Whether a candidate that is no base match is personal data, by its content."""
    found = text[start:end]
    if kind == "email":
        return DOMAIN.search(found) is not None
    if kind == "phone":
        return valid(kind, found) and (NATIONAL.fullmatch(found) is not None or CUES[3].search(text[max(0, start - 24) : start].lower()) is not None)
    return valid(kind, found)


LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
NUMBER = re.compile("[0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the email pattern in linear time: a run of local characters is walked once, back from its ``@``."""
    at, free = text.find("@"), 0
    while at >= 0:
        if at > free and (host := HOST.match(text, at + 1)) and (local := LOCAL.match(text[free:at][::-1])):
            yield at - len(local[0]), host.end()
            free = host.end()
        free = max(free, at + 1)
        at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the ip pattern in linear time: numbers joined by single dots, four after four."""
    for chain in CHAIN.finditer(text):
        if text.count(".", *chain.span()) >= 3:
            numbers = [m.span() for m in NUMBER.finditer(text, *chain.span())]
            yield from ((numbers[i][0], numbers[i + 3][1]) for i in range(0, len(numbers) - 3, 4))


def matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """All matches of a base pattern, leftmost and not overlapping, whether they pass their check or not."""
    if kind == "email":
        return emails(text)
    if kind == "ip":
        return addresses(text)
    return (m.span() for m in BASE[kind].finditer(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the base patterns that pass their check, by start, then kind."""
    out = []
    if "@" in text:
        out += [(s, 0, e, "email") for s, e in matches("email", text)]
    if DIGIT.search(text):
        for k, kind in enumerate(BASE):
            if kind == "email" or (kind == "phone" and "+" not in text):
                continue
            out += [(s, k, e, kind) for s, e in matches(kind, text) if valid(kind, text[s:e])]
    return [(kind, s, e) for s, _, e, kind in sorted(out)]


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the generators propose, base matches that fail their check included."""
    out = {}
    if "@" in text:
        out.update((("email", *span), None) for span in matches("email", text))
    digits = DIGIT.search(text) is not None
    if digits:
        for kind in ("ip", "card", "phone"):
            if kind != "phone" or "+" in text:
                out.update(((kind, s, e), None) for s, e in matches(kind, text) if e - s >= 7)
    for kind, pattern, hints in LOOSE:
        if (digits or kind == "email") and (hints is None or any(h in text for h in hints)):
            out.update(((kind, *m.span()), None) for m in pattern.finditer(text))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def with_check(kind: str, digits: str) -> str:
    """``digits`` with the last one (card) or the first two (account) set so that the check holds."""
    if kind == "card":
        return next(digits[:-1] + c for c in "0123456789" if luhn(digits[:-1] + c))
    rest = int("".join(str(int(c, 36)) for c in digits[4:] + digits[:2]) + "00") % 97
    return f"{digits[:2]}{98 - rest:02d}{digits[4:]}"


def planted(rng: random.Random, kind: str, words: list[str], genuine: bool) -> tuple[str, str]:
    """(lead, form): a loose form of a kind, or a decoy that looks like one. ``words`` are the surrounding text's."""
    number = lambda n, first="0123456789": rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))
    word = lambda: rng.choice(words).lower()
    grouped = lambda x, sep: sep.join(x[i : i + 4] for i in range(0, len(x), 4))
    lead = rng.choice((*LEADS[kind], "", "")) if genuine else rng.choice((*DECOY_LEADS, "", ""))
    # Half of the decoys have a genuine form's content, and only what leads them in gives them away.
    sound = genuine or (lead != "" and kind != "email" and rng.random() < 0.5)
    if kind == "email":
        if genuine:
            at, dot = rng.choice(((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."), (" @ ", ".")))
            return lead, f"{word()}{rng.choice(('', '.', '_'))}{word()}{at}{word()}{rng.choice(('', '-'))}{word()}{dot}{rng.choice(ENDS)}"
        last = rng.choice([w for w in map(str.lower, words) if w not in ENDS] or ["word"])
        return "", rng.choice((f"{word()} {rng.choice(('@', '(at)'))} {word()}{rng.choice((' . ', '. '))}{last.capitalize()}", f"{word()} @ {word()}.{last}", f"{word()}[at] {word()}.{last}", f"{word()}.{word()} (at) {word()}.{last}"))
    if kind == "ip":
        parts = [str(rng.randrange(256) if sound else rng.randrange(256, 999)) for _ in range(4)]
        return lead, rng.choice(("[.]", "(.)", " [dot] ", "(dot)")).join(parts)
    if kind == "card":
        digits = with_check("card", number(16, "3456"))
        if not sound:
            digits = digits[:-1] + str((int(digits[-1]) + rng.randrange(1, 10)) % 10)
        return lead, f"{grouped(digits, rng.choice((' ', '-')))} {number(3)}"  # with the code, so that the base pattern fails
    if kind == "phone":
        if sound:
            return lead, rng.choice((f"({number(3, '23456789')}) {number(3)}-{number(4)}", f"{number(3, '23456789')}-{number(3)}-{number(4)}", f"{number(3, '23456789')}.{number(3)}.{number(4)}", f"0{number(3, '123456789')} {number(3)} {number(4)}", f"(0{number(2, '123456789')}) {number(4)}-{number(4)}"))
        return lead, rng.choice((f"{number(3, '01')}-{number(4)}-{number(5)}", f"{number(3, '01')}/{number(3)}/{number(5)}", f"{number(3, '01')} {number(4)} {number(3)}"))
    if kind == "account":
        land, n = rng.choice((("DE", 18), ("FR", 23), ("ES", 20), ("NL", 14), ("GB", 18)))
        account = with_check("account", f"{land}00{number(n)}")
        if not sound:
            account = f"{land}{(int(account[2:4]) + rng.randrange(1, 90)) % 100:02d}{account[4:]}"
        return lead, grouped(account, rng.choice((" ", "")))
    first = f"{rng.randrange(1, 666):03d}" if sound else rng.choice(("000", "666", number(3, "9")))
    return lead, f"{first}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10_000):04d}"


def piece(rng: random.Random, text: str, kind: str, genuine: bool) -> tuple[str, int, int]:
    """(piece of ``text`` with a planted form, its start, its end)."""
    at = rng.randrange(len(text) + 1)
    before, after = text[max(0, at - 100) : at], text[at : at + 100]
    before, after = before[: before.rfind(" ") + 1] or " ", after[after.find(" ") :] if " " in after else ""
    words = re.findall("[a-z]{3,10}", (before + after).lower()) or ["some", "word"]
    lead, form = planted(rng, kind, words, genuine)
    lead = f"{before}{lead}{rng.choice((' ', ': ')) if lead else ''}"
    return f"{lead}{form}{rng.choice(('', '.', ','))} {after}", len(lead), len(lead) + len(form)


def planted_candidates(rng: random.Random, text: str) -> Iterator[tuple[str, tuple[str, int, int], float]]:
    """(piece, candidate, label) of one genuine form or decoy, for the candidates that touch it and are no base matches."""
    kind, genuine = rng.choice(KINDS), rng.random() < 0.5
    whole, start, end = piece(rng, text, kind, genuine)
    covered = merged(base_spans(whole))
    for c in candidates(whole):
        if c[1] < end and start < c[2] and apart(covered, *c[1:]):
            yield whole, c, float(genuine and c[0] == kind and valid(kind, whole[c[1] : c[2]]) and min(end, c[2]) - max(start, c[1]) >= 0.7 * (end - start))


def apart(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether [start, end) overlaps none of ``spans``, which are sorted and don't overlap one another."""
    i = bisect_left(spans, (end,))
    return i == 0 or spans[i - 1][1] <= start


def merged(base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What base spans, which may overlap those of other kinds, cover."""
    out: list[tuple[int, int]] = []
    for _, s, e in base:
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    found, before = text[start:end], text[max(0, start - 24) : start].lower()
    digits = sum("0" <= c <= "9" for c in found)
    groups = re.findall("[0-9]+", found)
    left, right = text[start - 1 : start], text[end : end + 1]
    return [
        KINDS.index(kind), len(found), digits, digits / len(found), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        found.count(" "), found.count("-"), found.count("."), found.startswith("+"), "(" in found, "@" in found,
        valid(kind, found), DOMAIN.search(found) is not None, "(at)" in found or "[at]" in found, NATIONAL.fullmatch(found) is not None,
        left.isalnum(), right.isalnum(), left in "\"'=:#/_" and left != "", found[:1] == "0", sum(c.isalpha() for c in found) / len(found),
        *[c.search(before) is not None for c in CUES],
    ]


@dataclass
class Model:
    trees: BoostedTrees | None
    thresholds: dict[str, float]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """Base spans and further selected ones, by start, then kind."""
        base = base_spans(text)
        return sorted([*base, *self.further(text, base)], key=lambda x: (x[1], KINDS.index(x[0]), x[2]))

    def further(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """The selected spans that aren't base spans; the likeliest first of those that overlap."""
        if self.trees is None or not self.thresholds:
            return []
        covered = merged(base)
        more = [c for c in candidates(text) if c[0] in self.thresholds and apart(covered, *c[1:])]
        if not more:
            return []
        p = self.trees.probability(np.array([features(text, *c) for c in more], float))
        kept = []
        for i in sorted(range(len(more)), key=lambda i: (-p[i], more[i][1])):
            kind, s, e = more[i]
            if p[i] >= self.thresholds[kind] and apart(covered, s, e):
                kept.append(more[i])
                insort(covered, (s, e))
        return kept


def eligible(text: str) -> Iterator[tuple]:
    """Candidates, and whether they are base matches; others don't overlap any, as when spans are selected."""
    base = base_spans(text)
    near, covered = set(base), merged(base)
    for c in candidates(text):
        if c in near or apart(covered, *c[1:]):
            yield c, c in near


def held_counts(texts: DataFrame, trees: BoostedTrees, least: dict[str, float]) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """kind -> (p, right, n): of all candidates of ``text`` that are no base matches and have a probability of ``least`` or more, how many lie in each step of probability from ``p`` on, and how many of them are personal data."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        kinds, x, y = [], [], []

        def scored() -> None:
            if x:
                p = trees.probability(np.array(x, float))
                n.update((k, math.floor(q * STEPS), right) for k, q, right in zip(kinds, p.tolist(), y, strict=True) if q >= least[k])
            for column in (kinds, x, y):
                column.clear()

        for batch in batches:
            for t in batch["text"].to_pylist():
                for c, base in eligible(t):
                    if not base and c[0] in least:
                        for column, value in zip((kinds, x, y), (c[0], features(t, *c), plausible(t, *c)), strict=True):
                            column.append(value)
                        if len(x) >= SCORED_AT_ONCE:
                            scored()
        scored()
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in n], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.bool_()))] + [pa.array(list(n.values()), pa.int64())], ["kind", "step", "sound", "n"])

    counted = texts.select("text").mapInArrow(work, "kind string, step int, sound boolean, n long").groupBy("kind", "step")
    rows = counted.agg(F.sum(F.when(F.col("sound"), F.col("n")).otherwise(0)).alias("sound"), F.sum("n").alias("n")).collect()
    out = {}
    for kind in least:
        mine = [r for r in rows if r["kind"] == kind]
        # The step that holds the least probability counts from that on.
        p = np.maximum(np.array([r["step"] / STEPS for r in mine], float), least[kind])
        out[kind] = p, np.array([r["sound"] for r in mine], np.int64), np.array([r["n"] for r in mine], np.int64)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 3) -> Model:
    """Trees from about SAMPLE_CANDIDATES candidates of each kind at most, base matches and others apart, and PLANTED pieces, drawn by hashes; thresholds from the pieces and all candidates of held-out documents.

    A first pass counts candidates and documents, a second one draws, a third one scores what is held out. Without both positive
    and negative candidates in the sample there are no trees, and only base spans are selected.
    """
    rows = docs.where(F.length(text_col) > 0).select(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed + 1)).alias("h"), F.col(text_col).alias("text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            n["", False] += batch.num_rows
            n.update((c[0], b) for t in batch["text"].to_pylist() for c, b in eligible(t))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in n], pa.string()), pa.array([b for _, b in n], pa.bool_()), pa.array(list(n.values()), pa.int64())], ["kind", "base", "n"])

    counts = rows.mapInArrow(tally, "kind string, base boolean, n long").groupBy("kind", "base").agg(F.sum("n").alias("n")).collect()
    rate = {(r["kind"], r["base"]): min(1.0, SAMPLE_CANDIDATES / r["n"]) for r in counts if r["kind"]}
    pieces = min(PLANTED_EACH, PLANTED / max(1, sum(r["n"] for r in counts if not r["kind"])))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for h, t in zip(batch["h"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for c, b in eligible(t):
                    if crc32(f"{seed}:{h}:{c}".encode()) < rate[c[0], b] * 2**32:
                        for column, value in zip(out, (h % 4 == 0, b, False, features(t, *c), float(b or plausible(t, *c))), strict=True):
                            column.append(value)
                rng = random.Random(f"{seed}:{h}")
                for _ in range(int(pieces + rng.random())):
                    for whole, c, label in planted_candidates(rng, t):
                        for column, value in zip(out, (h % 4 == 0, False, True, features(whole, *c), label), strict=True):
                            column.append(value)
            kinds = (pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.float64()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], ["held", "base", "sown", "x", "y"])

    flat = sorted((r["held"], r["base"], r["sown"], tuple(r["x"]), r["y"]) for r in rows.mapInArrow(draw, "held boolean, base boolean, sown boolean, x array<double>, y double").collect())
    held, base, sown = (np.array([f[i] for f in flat], bool) for i in range(3))
    x, y = np.array([f[3] for f in flat], float), np.array([f[4] for f in flat], float)
    if not len(flat) or len(set(y[~held])) < 2 or not held.any():
        return Model(None, {})
    of = x[:, 0].astype(int)
    group = 2 * of + base
    weight = np.array([1 / max(1, (group == g).sum()) for g in range(2 * len(KINDS))])[group]
    trees = BoostedTrees().fit(x[~held], y[~held], weight[~held] * len(flat) / len(KINDS))
    p = trees.probability(x)
    sown = held & ~base & sown
    thresholds = {name: t for k, name in enumerate(KINDS) if (t := lowest_threshold(p[sown & (of == k)], y[sown & (of == k)])) is not None}
    if thresholds:
        # The corpus's own candidates are held apart: where they need more, they decide, and where nothing is enough the kind is left out.
        for name, (step, right, n) in held_counts(rows.where(F.pmod("h", F.lit(4)) == 0), trees, thresholds).items():
            if n.sum() >= LEAST_SELECTED:
                if (own := lowest_threshold(step, right, n)) is None:
                    del thresholds[name]
                else:
                    thresholds[name] = own
    return Model(trees, thresholds)


def lowest_threshold(p: np.ndarray, right: np.ndarray, n: np.ndarray | None = None) -> float | None:
    """The lowest probability, LEAST_THRESHOLD or more, from which on LEAST_SELECTED or more candidates have the wanted precision; ``n`` candidates, one without it, stand at each of ``p``, ``right`` of them right."""
    order = np.argsort(-p, kind="stable")
    order = order[p[order] >= LEAST_THRESHOLD]
    total = np.cumsum((np.ones(len(p), np.int64) if n is None else n)[order])
    share = np.cumsum(right[order]) / total
    good = [i for i in range(len(order)) if total[i] >= LEAST_SELECTED and share[i] >= PRECISION and (i + 1 == len(order) or p[order[i + 1]] < p[order[i]])]
    return float(p[order[good[-1]]]) if good else None


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, findings array of (kind, start, end, base)) for every row of ``docs``, in code points; base spans first.

    Null texts are empty, repeated rows have rows of their own, null ids stay, an empty
    table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ("kind", "start", "end", "base")
    kind = pa.list_(pa.struct(list(zip(fields, (pa.string(), pa.int32(), pa.int32(), pa.bool_()), strict=True))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base = [base_spans(t or "") for t in b["text"].to_pylist()]
            more = [shared.value.further(t or "", x) for t, x in zip(b["text"].to_pylist(), base, strict=True)]
            found = [[dict(zip(fields, (*s, k == 0), strict=True)) for k, spans in enumerate(x) for s in spans] for x in zip(base, more, strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found, kind)], ["doc_id", "findings"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, findings array<struct<kind: string, start: int, end: int, base: boolean>>")


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with each selected span replaced by its kind in capitals in brackets, and n_chars, if there, set to the new length.

    Overlapping spans are replaced together by the first one's kind. Null texts stay null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for kind, s, e in shared.value.spans(text):
            if s >= at:
                out += [text[at:s], f"[{kind.upper()}]"]
            at = max(at, e)
        return "".join([*out, text[at:]]) if out else text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text_col)
            yield b.set_column(i, b.schema.field(i), pa.array([clean(t) for t in b[text_col].to_pylist()], b.schema.field(i).type))

    out = docs.mapInArrow(work, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(text_col).cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; one row for each document."""
    docs = read_table(spark, sf_dir, "documents")
    return digest(find(docs, fit(docs)), KINDS, tuple(BASE), lambda x: x["base"])
