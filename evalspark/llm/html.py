"""Main text of web pages by consensus host paths.

Each page is parsed twice. First its containers are scored by the prose they hold. The best one is widened to the
article or main element around it, else to the highest ancestor that adds little but prose and headings, and the
generalised tag-class path of that is the page's vote; Spark counts the votes per host. Then every page is read again and the blocks below
its host's winning path are its text. A page that lacks the winner uses the runners-up, then its own best container,
then whatever prose it has, so no page stays empty for the sake of its host.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by tag,
role or class word. A ``header`` inside an article keeps its headings. White space inside a block becomes one blank,
a line break is white space, character references are decoded, and blocks are joined by line feeds.

Edge cases. Null or empty html gives an empty text; a null url, or one without ``://``, belongs to the empty host.
Unclosed tags, stray end tags and cut-off markup are read as browsers do in outline. Repeated pages vote as often as
they occur. Columns of the input stay; ``text`` and ``n_chars`` are added or replaced.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .urls import host_of

RUNNERS_UP = 4
PROSE_FROM = 40  # characters of a block that counts as prose around the best container
PROSE_SHARE = 0.75  # of what an ancestor adds

# Element names by their role, and the class words of page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe xmp".split())
CONTAINERS = set("html body main article section div td center".split())
BLOCKS = CONTAINERS | set(
    "address aside blockquote dd details dialog dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li menu nav ol p pre summary table th tr ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ENDS_PARAGRAPH = BLOCKS - {"td", "html", "body", "tr", "summary"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FURNITURE_TAGS = set("head nav footer aside form menu dialog button select svg canvas object audio video".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar alert form".split())
FURNITURE_WORDS = set(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer comment comments reply replies respond disqus cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "pagination pager toolbar copyright disclaimer widget masthead skip search form".split())
HEADER_WORDS = {"header"}
WHOLE_PAGE = {"html", "body", "main", "article"}
LAYOUT_ONLY = set("sidebar header footer nav menu notice alert form search widget modal overlay cookie cookies social".split())

TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)|[!?][^>]*(?:>|\Z)|/[^a-zA-Z][^>]*>)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORD_BREAK = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
DIGITS = re.compile(r"\d+")


class Page:
    """Blocks of a page in order, each with the container it stands in; containers with parent and path."""

    def __init__(self, html: str):
        self.parents: list[int] = []
        self.paths: list[str] = []
        self.tags: list[str] = []
        self.blocks: list[tuple[int, str, int, bool, bool]] = []  # container, text, characters in links, in a list item, heading
        self._parse(html)

    def _open(self, parent: int, tag: str, classes: list[str]) -> int:
        words = sorted({DIGITS.sub("#", c) for c in classes})
        self.parents.append(parent)
        self.tags.append(tag)
        self.paths.append((self.paths[parent] if parent >= 0 else "") + "/" + ".".join([tag, *words]))
        return len(self.paths) - 1

    def _parse(self, html: str) -> None:
        # A stack entry: tag, container, skipped, only headings, in link, in list item
        stack = [("", self._open(-1, "", []), False, False, False, False)]
        parts: list[str] = []
        link = 0
        at = 0

        def flush() -> None:
            nonlocal link
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((owner, text, min(link, len(text)), in_item, heading))
                parts.clear()
            link = 0

        owner, in_item, heading = 0, False, False
        find, end = TAG.search, len(html)
        while at < end:
            m = find(html, at)
            start = m.start() if m else end
            if start > at:
                tag, container, skipped, headings, in_link, item = stack[-1]
                if not skipped and (not headings or tag in HEADINGS or any(s[0] in HEADINGS for s in stack[-4:])):
                    if not parts:
                        owner, in_item = container, item
                        heading = any(s[0] in HEADINGS for s in stack[-4:])
                    raw = html[at:start]
                    text = references.unescape(raw) if "&" in raw else raw
                    parts.append(text)
                    if in_link:
                        link += len(text.strip())
            if not m:
                break
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            tag = name.lower()
            if m.group(1):
                if tag in BLOCKS:
                    flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag in RAW:
                close = re.compile(r"</" + re.escape(tag) + r"(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = close.end() if close else end
                continue
            if tag in BLOCKS:
                flush()
            if tag in ENDS_PARAGRAPH:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in CONTAINERS or stack[k][0] in ("li", "blockquote", "aside", "nav", "form"):
                        break
            if tag in SAME_LEVEL:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in SAME_LEVEL[tag]:
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "menu", "select"):
                        break
            if tag in VOID or m.group(3).endswith("/") and tag not in BLOCKS:
                continue
            _, container, skipped, headings, in_link, item = stack[-1]
            classes: list[str] = []
            if not skipped:
                if "=" in m.group(3) or "hidden" in m.group(3):
                    attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(m.group(3))}
                    classes = references.unescape(attributes.get("class", "")).split()
                    skipped, headings = _furniture(tag, classes, attributes, m.group(3), headings)
                elif tag in FURNITURE_TAGS:
                    skipped = True
                elif tag == "header":
                    skipped, headings = not any(s[0] in ("article", "main") for s in stack), True
            if tag in CONTAINERS and not skipped:
                container = self._open(container, tag, classes)
            stack.append((tag, container, skipped, headings, in_link or tag == "a", item or tag == "li"))
        flush()


def _furniture(tag: str, classes: list[str], attributes: dict[str, str], raw: str, headings: bool) -> tuple[bool, bool]:
    """Whether an element is page furniture, and whether only its headings count."""
    if tag in FURNITURE_TAGS or attributes.get("role", "").lower() in FURNITURE_ROLES:
        return True, headings
    if attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True, headings
    bare = re.sub(r"\"[^\"]*\"|'[^']*'", "", raw)
    if re.search(r"(?:^|\s)hidden(?:\s|/|$)", bare):
        return True, headings
    words = {w.lower() for c in [*classes, attributes.get("id", "")] for w in WORD_BREAK.split(c)}
    bad = words & FURNITURE_WORDS
    if tag in WHOLE_PAGE:
        bad -= LAYOUT_ONLY
    if bad and tag not in ("html", "body"):
        return True, headings
    return False, headings or tag == "header" or bool(words & HEADER_WORDS and tag not in WHOLE_PAGE)


def container_scores(page: Page) -> list[float]:
    """Prose of every container: its own blocks in full, and half the score of each child container; links count against it."""
    scores = [0.0] * len(page.paths)
    for owner, text, link, item, _ in page.blocks:
        worth = len(text) - 2 * link + 10 * text.count(",")
        if worth > 0:
            scores[owner] += worth * (0.5 if item else 1.0)
    for i in range(len(scores) - 1, 0, -1):  # parents come before their children
        scores[page.parents[i]] += scores[i] / 2
    return scores


def widened(page: Page, best: int) -> int:
    """The article or main element around ``best``, else its highest ancestor that adds little but prose and headings."""
    at = best
    while at >= 0:
        if page.tags[at] in ("article", "main"):
            return at
        at = page.parents[at]
    size, good = [0] * len(page.paths), [0] * len(page.paths)
    for owner, text, link, _, heading in page.blocks:
        size[owner] += len(text)
        if heading or (len(text) >= PROSE_FROM and 2 * link < len(text)):
            good[owner] += len(text)
    for i in range(len(size) - 1, 0, -1):
        size[page.parents[i]] += size[i]
        good[page.parents[i]] += good[i]
    at = page.parents[best]
    while at >= 0:
        added = size[at] - size[best]
        if added and good[at] - good[best] < PROSE_SHARE * added:
            break
        best = at if added else best
        at = page.parents[at]
    return best


def best_container(page: Page) -> int | None:
    """The container with most prose (of equals the innermost, which comes later), widened to the whole article."""
    scores = container_scores(page)
    best = max(range(len(scores)), key=lambda i: (scores[i], i))
    return widened(page, best) if scores[best] > 0 else None


def text_below(page: Page, wanted) -> str:
    """Blocks inside the containers for which ``wanted`` holds, in page order."""
    inside = [False] * len(page.paths)
    for i, parent in enumerate(page.parents):  # parents come before their children
        inside[i] = wanted(i) or (parent >= 0 and inside[parent])
    return "\n".join(text for owner, text, *_ in page.blocks if inside[owner])


def main_text(html: str | None, winners: list[str]) -> str:
    page = Page(html or "")
    if not page.blocks:
        return ""
    for path in winners:
        if path in page.paths and (text := text_below(page, lambda i: page.paths[i] == path)):
            return text
    own = best_container(page)
    if own is not None and (text := text_below(page, lambda i: i == own)):
        return text
    return text_below(page, lambda i: True)


def vote(pages: DataFrame) -> DataFrame:
    """(host, path) of every page's best container; pages without prose cast none."""

    def paths(batches):
        for batch in batches:
            out = []
            for html in batch.column("html").to_pylist():
                page = Page(html or "")
                own = best_container(page)
                out.append(None if own is None else page.paths[own])
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string())], names=["host", "path"])

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(paths, "host string, path string").where("path is not null")


def elect(votes: DataFrame, runners_up: int = RUNNERS_UP) -> DataFrame:
    """(host, paths): the winning path of each host and its runners-up, most votes first (ties: the longer, then the first).

    Votes are folded in the map tasks, so a host with a third of all pages sends a few rows a task.
    """
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), F.desc(F.length("path")), "path"))
    best = counted.withColumn("rank", rank).where(F.col("rank") <= runners_up + 1)
    listed = best.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("ranked"))
    return listed.select("host", F.transform("ranked", lambda r: r["path"]).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """Add ``text`` and ``n_chars`` to pages (url, html, ...).

    The table of winners is stored before the join, so Spark broadcasts it where it is small and otherwise joins by
    host, splitting hot hosts.
    """
    winners = stored(elect(vote(pages)), "host-paths")
    kept = pages.drop("text", "n_chars", "_host", "_paths")
    joined = kept.withColumn("_host", host_of(F.col("url"))).join(
        winners.select(F.col("host").alias("_host"), F.col("paths").alias("_paths")), "_host", "left").drop("_host")

    def texts(batches):
        for batch in batches:
            rows = zip(batch.column("html").to_pylist(), batch.column("_paths").to_pylist())
            out = [main_text(html, paths or []) for html, paths in rows]
            names = [n for n in batch.schema.names if n != "_paths"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.string())], names=[*names, "text"])

    schema = T.StructType([f for f in joined.schema.fields if f.name != "_paths"] + [T.StructField("text", T.StringType())])
    return joined.mapInArrow(texts, schema).withColumn("n_chars", F.char_length("text").cast("long"))
