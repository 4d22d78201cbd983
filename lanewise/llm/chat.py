"""Chat formatting by incremental black-box rendering.

The template is a black box that turns a list of (role, text) into one string.
Nothing is assumed about its markup: the operator renders successive prefixes of
a conversation and compares consecutive outputs. What the longer output adds is
the new turn's span. Inside it, the text's own span is found by rendering the
prefix once with the turn's header only (``open_turn``) and once with an empty
text. An output that isn't an extension of the one before it means that the
template rewrites history; such conversations are reported, as their spans, and so
a loss mask, don't exist.

A template that declares no ``look_back`` is given whole prefixes, each turn's from the
conversation's start. One that declares that a turn's markup depends on no more than the
last ``look_back`` turns is given windows of that many turns that slide along the
conversation, so the work is linear in its length. The declaration is not trusted: at
each slide the window's output must be the tail of the longer window's, and at doubling
numbers of turns and at the end the whole prefix, however long, must render to what the
pieces gave. A template that fails is an error. The registered query declares nothing.

Spark shuffles the turns once by conversation and sorts them; each conversation is
then streamed, and one conversation's turns, two outputs and running digests are what a task holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import read_table

Turn = tuple[str, str]
#: The template's control strings.
HEAD, STOP = "###", "</turn>"


def escape(text: str, also: str = "") -> str:
    """Put a backslash before backslashes and control strings (and the characters of ``also``)."""
    text = text.replace("\\", "\\\\").replace(HEAD, "\\" + HEAD).replace(STOP, "\\" + STOP)
    for c in also:
        text = text.replace(c, "\\" + c)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


class TurnTemplate:
    """``### role: text</turn>`` and a line break for each turn.

    Control strings inside roles and texts are escaped, so no text can forge a turn
    and every turn can be read back exactly. A turn's markup depends on no other turn.
    """

    look_back = 0

    def render(self, turns: list[Turn]) -> str:
        return "".join(f"{HEAD} {escape(role, ':')}: {escape(text)}{STOP}\n" for role, text in turns)

    def open_turn(self, turns: list[Turn], role: str) -> str:
        """The output up to where the next turn's text begins."""
        return self.render(turns) + f"{HEAD} {escape(role, ':')}: "

    def read(self, piece: str) -> Turn:
        """The turn that a turn's piece of the output holds."""
        m = re.fullmatch(rf"{HEAD} ((?:\\.|[^\\:])*): (.*){STOP}\n", piece, flags=re.S)
        if m is None:
            raise ValueError("not a turn of this template")
        return unescape(m[1]), unescape(m[2])


class Renderer:
    """Renders one conversation turn by turn: ``add`` returns a turn's piece and its text's span in it.

    ``rewrites`` becomes true, and stays so, when a longer prefix's output doesn't
    extend a shorter one's. ``finish`` ends the conversation.
    """

    def __init__(self, template):
        self.template, self.window = template, getattr(template, "look_back", None)
        self.seen: list[Turn] = []  # the prefix's turns, or the window's
        self.output = ""  # the template's output for them
        self.rewrites = False
        self.opening = template.render([])
        # With a declared look-back: all turns, and a running digest of their pieces, which the whole rendering is held against.
        self.whole: list[Turn] = []
        self.digest = hashlib.sha256()

    def add(self, role: str, text: str) -> tuple[str, int, int]:
        render = self.template.render
        after = render([*self.seen, (role, text)])
        if not after.startswith(self.output):
            if self.window is not None:
                raise self._broken()
            self.rewrites = True
            self.seen.append((role, text))
            self.output = after
            return "", 0, 0
        piece = after[len(self.output) :]
        head = len(self.template.open_turn(self.seen, role)) - len(self.output)
        tail = len(render([*self.seen, (role, "")])) - len(self.output) - head
        self.seen.append((role, text))
        self.output = after
        if self.window is not None:
            self._slide(after)
            self._note(role, text, piece)
        return piece, head, len(piece) - tail

    def finish(self) -> None:
        if self.window is not None:
            self._check()

    def _slide(self, after: str) -> None:
        """Drop the window's first turn; what is left must give the tail of what it gave before, but for what opens every output."""
        if len(self.seen) > self.window:
            shorter = self.template.render(self.seen[1:])
            if not (shorter.startswith(self.opening) and after.endswith(shorter[len(self.opening) :])):
                raise self._broken()
            self.seen, self.output = self.seen[1:], shorter

    def _note(self, role: str, text: str, piece: str) -> None:
        self.whole.append((role, text))
        self.digest.update(piece.encode("utf-8", "surrogatepass"))
        if len(self.whole) & (len(self.whole) - 1) == 0:  # at doubling lengths, so all checks together cost about two renderings
            self._check()

    def _check(self) -> None:
        if hashlib.sha256(self.template.render(self.whole).encode("utf-8", "surrogatepass")).digest() != self.digest.digest():
            raise self._broken()

    def _broken(self) -> ValueError:
        return ValueError(f"{type(self.template).__name__} declares a look-back of {self.window} turns, but its output depends on others")


def format_conversations(
    df: DataFrame,
    template_factory: Callable[[], object] = TurnTemplate,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Each turn's piece of its conversation's formatted text, with spans.

    Returns (conv_id, place from 0, start, end, text_start, text_end, trained,
    rewrites, piece): code points in the conversation's formatted text, which is the
    pieces in order; the loss mask is [text_start, text_end) of rows with ``trained``
    (role exactly ``assistant``). ``rewrites`` says that the template rewrote history
    at or before this turn; its piece is then empty.

    Rows go by turn, ties by role then text, a null turn first; null roles and texts
    are empty strings, null conversation ids are one conversation, repeated rows are
    turns of their own, and other columns are ignored. No rows give no rows. A template
    whose output doesn't keep to the look-back that it declares is a ValueError.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = template_factory()
        now, renderer, place, at = object(), None, 0, 0
        for b in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(b[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != now:
                    if renderer:
                        renderer.finish()
                    now, renderer, place, at = conv, Renderer(template), 0, 0
                piece, lo, hi = renderer.add(role, text)
                out.append((conv, place, at, at + len(piece), at + lo, at + hi, role == "assistant" and not renderer.rewrites, renderer.rewrites, piece))
                place, at = place + 1, at + len(piece)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECES.types, strict=True)], schema=_PIECES)
        if renderer:
            renderer.finish()

    return _sorted_turns(df, conv_col, turn_col, role_col, text_col).mapInArrow(work, "conv_id long, place long, start long, end long, text_start long, text_end long, trained boolean, rewrites boolean, piece string")


_PIECES = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("place", "start", "end", "text_start", "text_end")], ("trained", pa.bool_()), ("rewrites", pa.bool_()), ("piece", pa.string())])


def _sorted_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    turns = df.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def read_back(pieces: DataFrame, template_factory: Callable[[], object] = TurnTemplate) -> DataFrame:
    """Per conversation, what can be read back from the formatted pieces of :func:`format_conversations`.

    ``pieces`` keeps its order: rows of a conversation follow one another within a
    partition. Digests are running, so no conversation is held whole.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = template_factory()
        state: list | None = None
        for b in batches:
            done = []
            for row in zip(*(b[c].to_pylist() for c in ("conv_id", "place", "text_start", "text_end", "start", "trained", "rewrites", "piece")), strict=True):
                conv, place, lo, hi, start, trained, rewrites, piece = row
                if place == 0:
                    if state:
                        done.append(_closed(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                state[1] += 1
                state[5] += len(piece)
                state[6] |= rewrites
                if rewrites:
                    continue
                role, text = template.read(piece)
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if trained:
                    learned = unescape(piece[lo - start : hi - start])
                    state[3] += len(learned)
                    state[4].update(learned.encode("utf-8", "surrogatepass"))
            if done:
                yield _rows(done)
        if state:
            yield _rows([_closed(state)])

    return pieces.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")


def _closed(s: list) -> tuple:
    return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.bool_())])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class WholePrefixes(TurnTemplate):
    """The same template without a declaration: every prefix is rendered whole and compared with the one before."""

    look_back = None


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation, and one whose texts hold control strings, and read the output back."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    return read_back(format_conversations(turns.unionByName(extra), WholePrefixes))
