"""Main text of web pages: containers scored per page, tag-class paths voted per host, text taken from the winner."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import NO_ID, original_id
from tallybook.llm.url_filter import host_and_path
from tallybook.session import stage

# Fixed values of HTML: elements without content, with raw text, that break lines, and that never hold main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE_TAGS = frozenset("head nav header footer aside form menu button select option input label dialog object audio video canvas annotation annotation-xml".split()) | RAW
CONTAINERS = frozenset("main article section div td center blockquote".split())
# An element closes an open paragraph when it starts; these close an open one of their own kind.
SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer form header hidden "
    "menu modal nav navbar navigation newsletter notice notices notification outbrain pagination pager popup promo promoted promotion related replies reply respond "
    "share sharing sidebar sidebars signup skip social sponsor sponsored subscribe taboola toolbar widget complementary contentinfo search alert discussion responses".split()
)
# Of these, words of what readers or notices say at length, where much text is no sign of an article; and words of wrappers.
LONG_WORDS = frozenset("comment comments consent cookie cookies disclaimer discussion disqus replies reply respond responses".split())
CONTENT_WORDS = frozenset("article body content entry main page post story text wrapper".split())

# A quote opens a value only right after its equals sign; anywhere else it is a character. Without its end it doesn't count.
_INSIDE = r"""(?>=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)|[^>])*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(sorted(RAW)) + rf")(?=[\s/>]){_INSIDE}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attributes>{_INSIDE})>|<[!?/][^>]*>",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NUMBER = re.compile(r"\d+")


class Element(NamedTuple):
    name: str
    number: int  # among all elements of the page
    along: int  # how far into the winning path the element's own path leads, -1 off it
    skipped: bool
    container: int  # number of the nearest container, itself included
    mark: int  # number of the marked element that it is in, if that alone makes it skipped, else -1


def _described(name: str, attributes: str) -> tuple[str, bool, set[str]]:
    """The element's step of a path, classes generalised, whether it is never main text, and the words that mark it."""
    skipped = name in BOILERPLATE_TAGS
    step = name
    words: set[str] = set()
    for key, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        value = next(filter(None, values), "")
        key = key.lower()
        if key == "class":
            step += "".join(f".{c}" for c in sorted({_NUMBER.sub("#", c) for c in value.lower().split()}))
        if key in ("class", "id", "role"):
            words.update(p.lower() for p in _PART.findall(value))
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            skipped = skipped or name not in ("body", "html")
    return step, skipped, words if name not in ("body", "html") and words & BOILERPLATE_WORDS else set()


class Mark:
    """An element with boilerplate words: its text outside and in links, and what speaks for a wrapper of main text."""

    def __init__(self, name: str, words: set[str]):
        self.good = self.linked = 0
        self.long = bool(words & LONG_WORDS)
        self.wrapper = name == "main" or not self.long and (name == "article" or bool(words & CONTENT_WORDS))

    def holds_main_text(self, outside: int) -> bool:
        """Most of the page's text, few links, and a sign of a wrapper; without a sign nearly all the text."""
        return self.good > self.linked and self.good > (1 if self.wrapper else 4) * outside and (self.wrapper or not self.long)


class Page(NamedTuple):
    """Elements as their parent's number and step of the path; containers in the order in which they open: element, whether on
    the winning path, parent, own text and skipped text; blocks of text by container; marked elements by number."""

    elements: list[tuple[int, str]]
    containers: list[int]
    winning: list[bool]
    parents: list[int]
    good: list[int]
    bad: list[int]
    blocks: list[tuple[int, str]]
    marks: dict[int, Mark]

    def path(self, container: int) -> str:
        """Steps from the page to a container. Paths are not kept, as those of deep nesting would take quadratic room."""
        steps, number = [], self.containers[container]
        while number:
            number, step = self.elements[number]
            steps.append(step)
        return "".join(f"/{step}" for step in reversed(steps) if step)


def parse(source: str, winner: str | None = None) -> Page:
    """A page without its boilerplate. Marked elements are left out, but for those on the winning path and those that
    hold the main text; the one with most text is let in first, then the others are judged by what is left outside."""
    kept: set[int] = set()
    while True:
        page = parse_once(source, kept, winner)
        outside = sum(page.good)
        found = [(m.good, -i) for i, m in page.marks.items() if m.holds_main_text(outside)]
        if not found:
            return page
        kept.add(-max(found)[1])


def parse_once(source: str, kept: set[int], winner: str | None) -> Page:
    """One pass over a page's tags. Missing end tags are closed by the end tag of whatever is around them."""
    page = Page([(0, "")], [0], [winner == ""], [-1], [0], [0], [], {})
    stack = [Element("", 0, -1 if winner is None else 0, False, 0, -1)]
    open_names: Counter[str] = Counter()
    parts: list[str] = []
    at_container = 0
    link_depth = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                page.blocks.append((at_container, text))

    def hear(text: str) -> None:
        nonlocal at_container
        top = stack[-1]
        if top.skipped:
            page.bad[top.container] += len(text.strip())
            if top.mark >= 0:
                mark = page.marks[top.mark]
                mark.good, mark.linked = mark.good + (not link_depth) * len(text.strip()), mark.linked + (link_depth > 0) * len(text.strip())
            return
        if top.container != at_container:
            flush()
            at_container = top.container
        parts.append(text)
        kept = len(text.strip())
        (page.bad if link_depth else page.good)[top.container] += kept

    def close(depth: int) -> None:
        nonlocal link_depth
        for gone in stack[depth:]:
            link_depth -= gone.name == "a"
            open_names[gone.name] -= 1
            if gone.name in BLOCKS:
                flush()
        del stack[depth:]

    def opened(name: str, inside: tuple[str, ...]) -> int | None:
        if not open_names[name]:  # the stack of a badly closed page is long
            return None
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name == name:
                return depth
            if stack[depth].name in inside:
                return None
        return None

    last = 0
    for token in _TOKEN.finditer(source):
        if token.start() > last:
            hear(source[last : token.start()])
        last = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if token["close"]:
            depth = opened(name, ())
            if depth is not None:
                close(depth)
            elif name in BLOCKS:
                flush()
            continue
        if name in ("br", "wbr", "hr"):
            if name == "hr":
                flush()
            elif name == "br" and not stack[-1].skipped:
                parts.append(" ")
            continue
        if name in VOID:
            continue
        if name in BLOCKS:
            flush()
            depth = opened("p", ("table", "td", "button"))
            if depth is not None:
                close(depth)
        if name in SELF_CLOSING:
            depth = opened(name, SELF_CLOSING[name])
            if depth is not None:
                close(depth)
        top = stack[-1]
        step, skipped, words = _described(name, token["attributes"])
        step = "" if name in ("html", "body") else step  # both tags may be left out
        along = top.along
        if step and along >= 0:
            along = along + len(step) + 1 if winner.startswith(f"/{step}", along) and winner[along + len(step) + 1 : along + len(step) + 2] in ("", "/") else -1
        number = len(page.elements)
        page.elements.append((top.number, step))
        mark = -1 if skipped else top.mark
        if mark >= 0 and not words and name in ("h1", "main", "article"):
            page.marks[mark].wrapper = True
        elif words and not skipped and not top.skipped and token.start() not in kept and along < 0:
            mark, skipped = token.start(), True
            page.marks[mark] = Mark(name, words)
        container = top.container
        if name in CONTAINERS and not skipped and not top.skipped:
            container = len(page.containers)
            page.containers.append(number)
            page.winning.append(winner is not None and along == len(winner))
            page.parents.append(top.container)
            page.good.append(0)
            page.bad.append(0)
        link_depth += name == "a"
        open_names[name] += 1
        stack.append(Element(name, number, along, skipped or top.skipped, container, mark))
    if last < len(source):
        rest = source[last:]
        hear(rest[: rest.rfind("<")] if re.search(r"<[a-zA-Z/!][^>]*\Z", rest) else rest)
    flush()
    return page


def best_container(page: Page) -> tuple[int, float]:
    """The container with the most text over twice its skipped text and links, parts of containers included."""
    good, bad = list(page.good), list(page.bad)
    for child in range(len(page.containers) - 1, 0, -1):
        good[page.parents[child]] += good[child]
        bad[page.parents[child]] += bad[child]
    # of equal scores the innermost: without a loss of text the tighter container is the better one
    score, best = max((good[i] - 2 * bad[i], i) for i in range(len(page.containers)))
    return best, float(score)


def inner_text(page: Page, wanted: set[int]) -> str:
    """All blocks inside the wanted containers, in page order, joined by one space."""
    inside = [False] * len(page.containers)
    for i, parent in enumerate(page.parents):
        inside[i] = i in wanted or parent >= 0 and inside[parent]
    return " ".join(text for container, text in page.blocks if inside[container])


def page_votes(pages: DataFrame) -> DataFrame:
    """(host, path, score): every page's best container; pages without any text don't vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, scores = [], [], []
            for host, text in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                page = parse(text.as_py())
                best, score = best_container(page)
                if page.blocks:
                    hosts.append(host), paths.append(page.path(best)), scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], ["host", "path", "score"])

    return pages.select("host", "html").mapInArrow(run, "host string, path string, score double")


def host_paths(votes: DataFrame) -> DataFrame:
    """(host, path): the path with most votes, then the larger summed score, then the smaller path."""
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("score"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("n", "score", F.xxhash64("path"), "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """Every row of ``pages`` as page_id, url, text, n_chars.

    The text is that of the containers on the host's winning path, without what is boilerplate inside them: elements that
    never hold main text, hidden ones, and those whose class, id or role has a boilerplate word, unless most of the page's
    text is in them, outside links. On a page
    without such a container, that of the page's own best one. Character references are decoded, white space inside a
    block becomes one space, blocks are joined by one space. A null html is empty, its text the empty string; pages
    with a null url share the empty host; repeated rows get the same result. Other columns are ignored.
    """
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_and_path(F.col("url").cast("string"))[0].alias("host"),
    )
    winners = stage(host_paths(page_votes(rows)), "paths").withColumnRenamed("path", "winner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, winner in zip(batch.column("html"), batch.column("winner").to_pylist(), strict=True):
                page = parse(source.as_py(), winner)
                wanted = {i for i, on in enumerate(page.winning) if on}
                texts.append(inner_text(page, wanted or {best_container(page)[0]}))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    found = rows.join(winners, "host", "left").select("page_id", "url", "html", "winner")
    texts = found.mapInArrow(run, "page_id long, url string, text string")
    return texts.select(original_id("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
