"""Reading pages: text, embedded state, tables of contents, main content. The parsing is Python's, in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from corpusmill.functions import text as tx
from pyspark.sql import Column, DataFrame, Window, functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_DROPPED = frozenset("script style nav footer img figure aside".split())
_LINES = frozenset("h1 h2 h3 h4 p li table".split())
# Where the main content is looked for, in this order: (tag or None, attribute, value).
MAIN = (("div", "data-book-content", "true"), ("div", "data-type", "page"), ("main", None, None), ("article", None, None))


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: "_Node | None"):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def strings(self, dropped: frozenset = frozenset()) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                if c.strip():
                    yield c.strip()
            elif c.tag not in dropped:
                yield from c.strings(dropped)

    def walk(self) -> Iterator["_Node"]:
        for c in self.children:
            if not isinstance(c, str):
                yield c
                yield from c.walk()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(_Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _parse(html: str) -> _Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def text_of(html: str) -> str:
    """All strings of a page, stripped, with one blank between them; entities decoded."""
    return " ".join(_parse(html).strings())


def main_content(html: str) -> str:
    """Headings (with # marks), paragraphs, list items (with -) and tables of the main element, a blank line between them.

    ValueError if there is no main element or nothing in it. Elements inside others of these come out twice."""
    root = _parse(html)
    main = next((n for tag, key, value in MAIN for n in root.walk() if n.tag == tag and (key is None or n.attrs.get(key) == value)), None)
    if main is None:
        raise ValueError("no main content")
    lines: list[str] = []

    def visit(node: _Node) -> None:
        for c in node.children:
            if isinstance(c, str) or c.tag in _DROPPED:
                continue
            if c.tag in _LINES and (text := " ".join(c.strings(_DROPPED))):
                lines.append("#" * int(c.tag[1]) + " " + text if c.tag[0] == "h" else "- " + text if c.tag == "li" else text)
            visit(c)

    visit(main)
    content = "\n\n".join(lines).strip()
    if not content:
        raise ValueError("empty main content")
    return content


def preloaded_state(html: str, marker: str = "__PRELOADED_STATE__") -> dict:
    """The object behind the marker, found by counting braces (those inside strings too); ValueError if there is none."""
    at = html.find(marker)
    start = html.find("{", at) if at >= 0 else -1
    if start < 0:
        raise ValueError("no preloaded state")
    depth = 0
    for i in range(start, len(html)):
        depth += (html[i] == "{") - (html[i] == "}")
        if not depth:
            return json.loads(html[start : i + 1])
    raise ValueError("unbalanced preloaded state")


def contents_tree(state: dict) -> dict:
    """The contents tree of a page's state: that of its book, where it has one, else the state itself."""
    for step in ("content", "book", "tree"):
        below = state.get(step)
        if not isinstance(below, dict):
            break
        state = below
    return state


def flatten_toc(node: dict) -> list[dict]:
    """Entries of a contents tree, parents first, titles without tags; a node with the slug index and all below it is left out."""
    slug = node.get("slug")
    if slug == "index":
        return []
    children = node.get("contents") or node.get("children") or []
    out = [{"section_slug": slug, "title": text_of(str(node.get("title") or "")) or slug}] if slug and (node.get("toc_target_type") or not children) else []
    return out + [x for c in children for x in flatten_toc(c)]


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, content, error: the main content of every page, or why it has none. Failed pages stay, to be quarantined."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page in pdf["html"]:
                try:
                    rows.append((main_content(page or ""), None))
                except ValueError as e:
                    rows.append((None, str(e)))
            yield pd.DataFrame({"key": pdf["key"], "content": [r[0] for r in rows], "error": [r[1] for r in rows]})

    kind = dict(pages.dtypes)[key]
    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key {kind}, content string, error string").withColumnRenamed("key", key)


def scraped(extracted: DataFrame, key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(pages with content, quarantined pages)."""
    return extracted.where("error is null").drop("error"), extracted.where("error is not null").drop("content")


def toc(pages: DataFrame, html: str = "html", position: str = "page_id", book: str | None = None, base_url: str = "") -> DataFrame:
    """section_slug, title, chapter_number, section_number, url of the contents trees in the pages' preloaded state; the first entry of each slug.

    Numbers are those a slug begins with, null without. `book` is a column with the slug of a page's book: a
    section's address is base_url/books/book/pages/section, or base_url/section without one; entries are then per book."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for pos, own, page in zip(pdf["pos"], pdf["book"], pdf["html"]):
                try:
                    rows += [(pos, own, i, x["section_slug"], x["title"]) for i, x in enumerate(flatten_toc(contents_tree(preloaded_state(page or ""))))]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=["pos", "book", "place", "section_slug", "title"])

    own = F.col(book).cast("string") if book else F.lit("")
    entries = pages.select(F.col(position).cast("long").alias("pos"), own.alias("book"), F.col(html).alias("html")).mapInPandas(run, "pos long, book string, place int, section_slug string, title string")
    first = entries.groupBy("book", "section_slug").agg(F.min_by("title", F.struct("pos", "place")).alias("title"))
    chapter, section = tx.slug_numbers(F.col("section_slug"))
    url = F.concat_ws("/", F.lit(base_url), F.lit("books"), "book", F.lit("pages"), "section_slug") if book else F.concat_ws("/", F.lit(base_url), "section_slug")
    return first.select(*([F.col("book").alias(book)] if book else []), "section_slug", "title", chapter.alias("chapter_number"), section.alias("section_number"), url.alias("url"))


def text_column(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(text_of, na_action="ignore"), "string")(c)


def first_per_slug(entries: DataFrame, position: str) -> DataFrame:
    by = Window.partitionBy("section_slug").orderBy(position)
    return entries.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
