"""Main text of web pages by consensus paths of their hosts.

*Score.* Each page is parsed once, in linear time, into a list of blocks of text, each with
the place of its innermost container in the tree of the page's container paths; the blocks
are written as a table in the shared folder. A container's path is generalised: tag names, with classes freed of digits.
A container scores the text of the paragraphs right inside it, half of those one level
down, less the text in links; where several like containers stand side by side, as
paragraphs in boxes of their own do, the one around them scores all of it.

*Vote.* A page votes for the path of its best container. Spark counts the votes by host and
path, with partial counts in each task. The paths that two pages of a host at least vote
for are the host's, by their votes, so a host of several kinds of pages has a path for each.

*Extract.* The blocks are read again with their host's paths: the first path that the page
has gives the text. A page without any of them uses its own best container, so each page
gets its text. This step is plain DataFrame expressions. Menus, headers, footers, sidebars, notices, adverts, forms, comments,
scripts and styles are left out wherever they stand.

Pages meet their host's paths by a join; the paths are broadcast only below a checked
number. A host with a third of all pages is the large side of that join and can be split.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import read_table, write_scratch

#: Paths of hosts that may be broadcast; characters of a path beyond which its beginning is replaced by a hash.
BROADCAST_PATHS, PATH_CHARS = 100_000, 200

#: Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head nav footer aside form button select textarea iframe object svg canvas audio video dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CONTAINERS = frozenset("article main section div td body center blockquote".split())
LISTS = frozenset(("ul", "ol", "dl", "table"))
IMPLIED_END = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
#: Words in classes and ids of what isn't the article.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumb\w*|sidebar|side|aside|footer|foot|masthead|siteheader|topbar|toolbar|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay"
    r"|comment\w*|disqus|respond|replies|reply|related|recommend\w*|share|sharing|social|subscribe|subscription|newsletter|signup|login|search|form|pagination|pager|widget|copyright|hidden|skip)(?=$|[\s_-]|\d)"
)
_QUALIFIED = re.compile(r"\b(?:has|with|no|without|is|not)[-_]\S+")
PREFERRED = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story|text|body)(?=$|[\s_-]|\d)")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile(r"""=\s*(["'])|>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][-\w:]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")}


_STOPS = CONTAINERS | LISTS | frozenset(IMPLIED_END)


class Tags:
    """The markup of a page in order: (text before it, end tag or not, tag name, attributes), each place looked at a bounded number of times.

    A quote counts where a value begins. Once a tag is found that never ends because of its
    quotes, quotes count no more; a tag that has no end at all is text, as is all after it.
    """

    def __init__(self, source: str):
        self.source, self.at = source, 0
        self.quotes = self.sections = True

    def __iter__(self) -> Iterator[tuple[str, bool, str, str]]:
        source, find = self.source, self.source.find
        while (lt := find("<", self.at)) >= 0:
            before = source[self.at : lt]
            if source.startswith(("!", "?"), lt + 1):
                yield before + self._declaration(lt), False, "", ""
                continue
            name = _NAME.match(source, lt + 1)
            if name is None:
                self.at = lt + 1
                yield before + "<", False, "", ""
                continue
            end = self._end(name.end())
            if end < 0:
                break
            self.at = end + 1
            yield before, bool(name[1]), name[2].lower(), source[name.end() : end]
        yield source[self.at :], False, "", ""

    def _declaration(self, lt: int) -> str:
        """Skips a comment or a declaration; the text that a section holds."""
        source = self.source
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            self.at = end + 3 if end >= 0 else len(source)
            return ""
        if self.sections and source.startswith("<![CDATA[", lt):
            end = source.find("]]>", lt + 9)
            if end >= 0:
                self.at = end + 3
                return html.escape(source[lt + 9 : end])
            self.sections = False
        end = source.find(">", lt + 2)
        self.at = end + 1 if end >= 0 else len(source)
        return ""

    def _end(self, at: int) -> int:
        if self.quotes:
            start = at
            while (m := _QUOTE_OR_END.search(self.source, at)) is not None:
                if m[1] is None:
                    return m.start()
                at = self.source.find(m[1], m.end()) + 1
                if not at:
                    break
            self.quotes, at = False, start
        return self.source.find(">", at)


class Open:
    """An open element: its container or the one around it, whether its text is dropped, the nearest element that may stop an implied end, whether it is in an article."""

    __slots__ = ("tag", "container", "own", "dropped", "stop", "inside")

    def __init__(self, tag: str, container: int, own: bool, dropped: bool, stop: int, inside: bool):
        self.tag, self.container, self.own, self.dropped, self.stop, self.inside = tag, container, own, dropped, stop, inside


class Page:
    """Blocks (text, characters in links, innermost container or -1) and containers of a page; ``paths[i]`` is the generalised path of container i."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int]] = []
        self.paths: list[str] = []
        self.parents: list[int] = []
        self.preferred: list[float] = []
        self._read(source)

    def _read(self, source: str) -> None:
        self.stack: list[Open] = []
        self.count: dict[str, int] = {}  # open elements by tag
        self.inline: list[dict[str, int]] = [{}]  # open inline elements by tag, since each open block
        self.pieces: list[str] = []
        self.linked = self.links = 0
        tags = Tags(source)
        for text, ends, tag, attributes in tags:
            self._text(text)
            if not tag:
                continue
            if ends:
                self._close(tag)
            elif tag in VOID:
                if tag == "br":
                    self._text(" ")
                elif tag == "hr":
                    self._flush()
            elif tag in _RAW_END:
                end = _RAW_END[tag].search(source, tags.at)
                tags.at = end.end() if end else len(source)
                self._flush()
            else:
                self._open(tag, attributes)
        self._flush()
        del self.stack, self.count, self.inline, self.pieces

    def _text(self, piece: str) -> None:
        if piece and not (self.stack and self.stack[-1].dropped):
            self.pieces.append(piece)
            self.linked += len(piece) if self.links else 0

    def _flush(self) -> None:
        if self.pieces:
            if text := " ".join(html.unescape("".join(self.pieces)).split()):
                self.blocks.append((text, self.linked, self.stack[-1].container if self.stack else -1))
            self.pieces, self.linked = [], 0

    def _pop(self) -> None:
        tag = self.stack[-1].tag
        if tag in INLINE:
            self.inline[-1][tag] -= 1
            self.links -= tag == "a"
        else:
            self._flush()
            self.inline.pop()
        self.count[tag] -= 1
        self.stack.pop()

    def _close(self, tag: str) -> None:
        """An end tag without a start, or of an inline element around blocks, closes nothing."""
        if tag in INLINE:
            if self.inline[-1].get(tag):
                while self.stack[-1].tag != tag:
                    self._pop()
                self._pop()
        elif self.count.get(tag):
            while self.stack[-1].tag != tag:
                self._pop()
            self._pop()
        else:
            self._flush()

    def _imply_ends(self, tag: str) -> None:
        """A block ends an open paragraph; items end their like, up to the list or table they stand in."""
        ends, stack = IMPLIED_END.get(tag, frozenset()), self.stack
        while stack:
            i = stack[-1].stop
            while i >= 0 and not (stack[i].tag == "p" or stack[i].tag in ends or stack[i].tag in LISTS or stack[i].tag in CONTAINERS):
                i = stack[i - 1].stop if i else -1
            if i < 0 or not (stack[i].tag == "p" or stack[i].tag in ends):
                break
            while len(stack) > i:
                self._pop()
        # Inline elements left open don't reach into a new block.
        while stack and stack[-1].tag in INLINE:
            self._pop()

    def _open(self, tag: str, written: str) -> None:
        block = tag not in INLINE
        if block:
            self._imply_ends(tag)
            self._flush()
        around = self.stack[-1] if self.stack else None
        attributes = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(written)} if written else {}
        name = _QUALIFIED.sub("", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())
        inside = around is not None and around.inside
        dropped = (
            (around is not None and around.dropped)
            or tag in SKIPPED
            or (tag == "header" and not inside)
            or "hidden" in attributes
            or attributes.get("aria-hidden") == "true"
            or "display:none" in attributes.get("style", "").replace(" ", "")
            or attributes.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form")
            or (tag not in ("article", "main", "body", "html") and name.strip() != "" and BOILERPLATE.search(name) is not None and not (block and PREFERRED.search(attributes.get("class", "").lower()) and not re.search(r"comment|sidebar|foot|menu|nav", name)))
        )
        container, own = around.container if around else -1, tag in CONTAINERS and not dropped
        if own:
            classes = " ".join(re.sub(r"\d+", "", c) for c in attributes.get("class", "").lower().split())
            path = f"{self.paths[container] if container >= 0 else ''}/{tag}" + "".join(f".{c}" for c in sorted(set(classes.split())))
            if len(path) > PATH_CHARS:
                path = f"#{hashlib.blake2b(path.encode('utf-8', 'replace'), digest_size=8).hexdigest()}"
            self.paths.append(path)
            self.parents.append(container)
            self.preferred.append(2.0 if tag in ("article", "main") else 1.5 if PREFERRED.search(name) else 1.0)
            container = len(self.paths) - 1
        stop = len(self.stack) if tag in _STOPS else around.stop if around else -1
        self.stack.append(Open(tag, container, own, dropped, stop, inside or tag in ("article", "main")))
        self.count[tag] = self.count.get(tag, 0) + 1
        if block:
            self.inline.append({})
        else:
            self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1
            self.links += tag == "a"
        if tag == "path" and written.rstrip().endswith("/"):
            self._pop()

    def scores(self) -> dict[str, float]:
        """Each container path's score on this page."""
        score = [0.0] * len(self.paths)
        alike: dict[tuple[int, str], int] = {}
        for key in zip(self.parents, self.paths, strict=True):
            alike[key] = alike.get(key, 0) + 1
        for text, linked, last in self.blocks:
            if last >= 0:
                kept, above = max(0.0, len(text) - 2.0 * min(len(text), linked)), self.parents[last]
                several = above >= 0 and alike[above, self.paths[last]] > 1
                score[last] += kept / 2 if several else kept
                if above >= 0:
                    score[above] += kept if several else kept / 2
        out: dict[str, float] = {}
        for path, s, w in zip(self.paths, score, self.preferred, strict=True):
            if s > 0:
                out[path] = out.get(path, 0.0) + s * w
        return out

    def best(self) -> str | None:
        """The path with the highest score, the first one by name of equal ones; None if none scores."""
        return min(self.scores().items(), key=lambda x: (-x[1], x[0]), default=(None, 0.0))[0]

    def tree(self) -> tuple[list[str], list[int], list[int]]:
        """(paths of containers with text, each before those inside it; the place of the last path inside each; the place of each block's innermost path or -1)."""
        held: set[int] = set()
        for _, _, c in self.blocks:
            while c >= 0 and c not in held:
                held.add(c)
                c = self.parents[c]
        within: dict[str, list[str]] = {}
        tops: list[str] = []
        for c in sorted(held):
            if self.paths[c] not in within:
                within[self.paths[c]] = []
                (tops if self.parents[c] < 0 else within[self.paths[self.parents[c]]]).append(self.paths[c])
        place: dict[str, int] = {}
        last: list[int] = []
        todo = [(p, False) for p in reversed(tops)]
        while todo:
            path, left = todo.pop()
            if left:
                last[place[path]] = len(place) - 1
                continue
            place[path] = len(place)
            last.append(0)
            todo.append((path, True))
            todo += [(p, False) for p in reversed(within[path])]
        return list(place), last, [place[self.paths[c]] if c >= 0 else -1 for _, _, c in self.blocks]

    def extract(self, path: str) -> str | None:
        """The text in containers with this path, in page order; None if the page has none with text."""
        wanted: list[bool] = []
        for p, up in zip(self.paths, self.parents, strict=True):
            wanted.append(p == path or (up >= 0 and wanted[up]))
        texts = [t for t, _, c in self.blocks if c >= 0 and wanted[c]]
        return " ".join(texts) if texts else None

    def main_text(self, paths: list[str]) -> str:
        """The page's text by the paths of its host; what the DataFrame form computes."""
        for path in paths:
            if (found := self.extract(path)) is not None:
                return found
        if (own := self.best()) is not None:
            return self.extract(own) or ""
        return " ".join(t for t, _, _ in self.blocks)


def host_of(url: str = "url"):
    """The host of a URL in lower case, without user, port and a leading ``www.``; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, names, last, blocks, best): what :meth:`Page.tree` gives for each page, with its blocks' texts, and the path it votes for."""
    kinds = {
        "names": pa.list_(pa.string()),
        "last": pa.list_(pa.int32()),
        "blocks": pa.list_(pa.struct([("text", pa.string()), ("at", pa.int32())])),
        "best": pa.string(),
    }

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, last, blocks, best = [], [], [], []
            for source in b["html"].to_pylist():
                page = Page(source or "")
                for column, value in zip((names, last, blocks), page.tree(), strict=True):
                    column.append(value)
                blocks[-1] = [{"text": t, "at": at} for (t, _, _), at in zip(page.blocks, blocks[-1], strict=True)]
                best.append(page.best())
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], b["host"], *[pa.array(x, k) for x, k in zip((names, last, blocks, best), kinds.values(), strict=True)]], ["page_id", "url", "host", *kinds])

    return pages.mapInArrow(work, "page_id long, url string, host string, names array<string>, last array<int>, blocks array<struct<text: string, at: int>>, best string")


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the container paths that two pages of the host at least vote for, those with the most votes first."""
    votes = pages.where("best is not null").groupBy("host", F.col("best").alias("path")).agg(F.count("*").alias("votes"))
    shared = votes.where("votes > 1").groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("less"), "path"))).alias("x"))
    return shared.select("host", F.col("x.path").alias("paths"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Null or empty html gives an empty text; a null or odd URL is of the host ``''``;
    repeated rows vote and are returned each; ties of votes go to the first path by name;
    an empty table gives an empty result, and other columns are ignored. A page none of
    whose containers scores gives all its text. Parsing takes time in proportion to a page.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    blocks = write_scratch(parsed(rows), "html-blocks")
    paths = write_scratch(host_paths(blocks), "html-paths")
    if paths.agg(F.coalesce(F.sum(F.size("paths")), F.lit(0))).first()[0] <= BROADCAST_PATHS:
        paths = F.broadcast(paths)
    known = F.get(F.array_intersect(F.coalesce("paths", F.array().cast("array<string>")), "names"), F.lit(0))
    chosen = F.coalesce(known, F.col("best"))
    out = blocks.join(paths, "host", "left").withColumn("i", F.coalesce(F.array_position("names", chosen), F.lit(0)).cast("int") - 1)
    out = out.withColumn("to", F.get("last", F.col("i")))
    kept = F.when(F.col("i") < 0, F.col("blocks")).otherwise(F.filter("blocks", lambda x: x["at"].between(F.col("i"), F.col("to"))))
    out = out.select("page_id", "url", F.array_join(F.transform(kept, lambda x: x["text"]), " ").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_texts(read_table(spark, sf_dir, "pages"))
