"""Collecting pages: extraction from HTML and XML, line clean-up, change detection, reachability."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from itertools import count
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import urls
from lodestone.functions import values as V
from lodestone.functions.text import col, let, strip

#: Levels of a search that are kept apart.
JOINED = 16
TEXT_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


def normalized_space(x: Column | str) -> Column:
    """Blanks and tabs as one blank, at most one empty line between lines, ends stripped."""
    plain = F.regexp_replace(F.regexp_replace(col(x), " ", " "), "[ \t]+", " ")
    return strip(F.regexp_replace(plain, "\n{3,}", "\n\n"))


def is_noise(line: Column | str) -> Column:
    out = (col(line) == "") | col(line).isin(*V.NOISE_LINES)
    for prefix in V.NOISE_PREFIXES:
        out = out | col(line).startswith(prefix)
    return F.coalesce(out, F.lit(True))


def deduplicated_lines(lines: Column | str) -> Column:
    """Distinct lines in order, without those that hold another long line and more."""
    holds = lambda long, line: F.exists(long, lambda o: (F.length(line) > F.length(o) + 20) & line.contains(o))
    split = lambda once: F.struct(once.alias("once"), F.filter(once, lambda o: F.length(o) >= 40).alias("long"))
    return let(F.array_distinct(col(lines)), lambda once: let(split(once), lambda b: F.filter(b["once"], lambda line: ~holds(b["long"], line))))


def content_hash(x: Column | str) -> Column:
    return F.sha2(col(x), 256)


def word_count(x: Column | str) -> Column:
    return F.size(F.filter(F.split(col(x), r"(?U)\s+"), lambda w: w != ""))


def anchors(html: Column | str) -> Column:
    """Link targets of ``<a href="...">`` in order, without fragments, mail and scripts."""
    found = F.regexp_extract_all(col(html), F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    bare = F.transform(found, strip)
    return F.filter(bare, lambda h: (h != "") & ~h.startswith("#") & ~h.startswith("mailto:") & ~h.startswith("javascript:"))


class _Node:
    __slots__ = ("attrs", "parts", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.parts = tag, attrs, []

    def walk(self) -> Iterator[_Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed([p for p in node.parts if isinstance(p, _Node)]))

    def text(self) -> str:
        """Stripped strings joined by blanks."""
        out, todo = [], [self]
        while todo:
            part = todo.pop()
            if isinstance(part, str):
                if part.strip():
                    out.append(part.strip())
            elif part.tag not in ("script", "style"):
                todo.extend(reversed(part.parts))
        return " ".join(out)

    def first(self, test) -> _Node | None:
        return next((n for n in self.walk() if n is not self and test(n)), None)


class _Tree(HTMLParser):
    """A tree of a page; an end tag closes the innermost open element of its name, if there is one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].parts.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def tree(html: str) -> _Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def _space(text: str) -> str:
    text = re.sub(r"[ \t]+", " ", text.replace("\xa0", " "))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _has_class(node: _Node, name: str) -> bool:
    return name in node.attrs.get("class", "").split()


def container(root: _Node, portal: bool) -> _Node:
    """The element with a page's content: on the portal its right region or main content if they say enough."""
    main = root.first(lambda n: n.tag == "main")
    if portal:
        inner = main.first(lambda n: _has_class(n, "region-content")) if main else None
        for found in (root.first(lambda n: _has_class(n, "bs-region--right")), inner):
            if found is not None and len(found.text()) > 80:
                return found
    return main if main is not None else root


def _meta(root: _Node, names: tuple[str, ...]) -> Iterator[str]:
    for name in names:
        node = root.first(lambda n, name=name: n.tag == "meta" and n.attrs.get("name") == name)
        if node is not None and node.attrs.get("content"):
            yield _space(node.attrs["content"])


def page_title(root: _Node, within: _Node) -> str:
    for node in (within.first(lambda n: n.tag == "h1"),):
        if node is not None and _space(node.text()):
            return _space(node.text())
    for found in _meta(root, ("dc.title", "dcterms.title")):
        return found
    node = root.first(lambda n: n.tag == "title")
    return (_space(node.text()) if node is not None else "") or "Untitled"


def page_date(root: _Node, text: str) -> str | None:
    """The date of last change: of the metadata, of a time element, or as the page says it."""
    shown = [root.first(lambda n: n.tag == "time" and n.attrs.get("property") == "dateModified")]
    block = root.first(lambda n: n.attrs.get("id") == "wb-dtmd")
    shown.append(block.first(lambda n: n.tag == "time") if block is not None else None)
    for found in [*_meta(root, ("dcterms.modified", "dc.date.modified")), *(_space(n.text()) for n in shown if n is not None)]:
        if _DATE.match(found):
            return found
    said = re.search(r"Date modified:\s*(\d{4}-\d{2}-\d{2})", text, re.IGNORECASE)
    return said[1] if said else None


def page_lines(within: _Node) -> list[str]:
    """Texts of headings, paragraphs and items that hold no other such element."""
    nodes = [n for n in within.walk() if n is not within and n.tag in TEXT_TAGS]
    leaves = [n for n in nodes if n.first(lambda x: x.tag in TEXT_TAGS) is None]
    return [t for t in (_space(n.text()) for n in leaves) if t]


def page_parts(html: str, portal: bool) -> tuple[str, str | None, list[str]]:
    """(title, date, lines) of a page's HTML."""
    root = tree(html)
    within = container(root, portal)
    return page_title(root, within), page_date(root, _space(root.text())), page_lines(within)


def extracted(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, title, date_modified, text): pages as documents. Lines are cleaned by Columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, source in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                out.append(page_parts(source or "", host == V.PORTAL_HOST))
            own = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], names=["k", "u", "title", "date_modified", "lines"])

    source = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), urls.host(F.col(url)).alias("h"), F.col(html).alias("s"))
    kind = source.schema["k"].dataType.simpleString()
    found = source.mapInArrow(run, f"k {kind}, u string, title string, date_modified string, lines array<string>")
    lines = deduplicated_lines(F.filter("lines", lambda x: ~is_noise(x)))
    return found.select(F.col("k").alias(key), F.col("u").alias(url), "title", "date_modified", normalized_space(F.array_join(lines, "\n")).alias("text"))


def directive_document(xml: str) -> tuple[str, str, str | None]:
    """(title, text, date) of a directive's XML."""
    title, date, lines = directive_lines(xml)
    return title, _space("\n".join(lines)), date


def directive_lines(xml: str) -> tuple[str, str | None, list[str]]:
    """(title, date, lines) of a directive's XML: titles of its parts and whole clauses, each after its anchor."""
    root = ET.fromstring(xml)
    lines: list[str] = []

    def say(node: ET.Element, text: str) -> None:
        if text:
            line = f"{node.attrib.get('anchor', '').strip()} {text}".strip()
            if not lines or lines[-1] != line:
                lines.append(line)

    todo = [root]
    while todo:
        node = todo.pop()
        tag = node.tag.lower()
        if tag == "clause":
            say(node, _space(" ".join(node.itertext())))
            continue
        if tag in ("chapter", "appendix", "section"):
            say(node, _space(node.attrib.get("title", "")))
        todo.extend(reversed(list(node)))
    said = re.search(r"Date modified:\s*(\d{4}-\d{2}-\d{2})", _space(" ".join(root.itertext())), re.IGNORECASE)
    return _space(root.attrib.get("title", "Directive on the Management of Procurement")), said[1] if said else None, lines


def links(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(source, position, target): absolute links of pages in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(base, i, urljoin(base or "", href)) for base, hrefs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, href in enumerate(hrefs or ())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["source", "position", "target"])

    return pages.select(F.col(url), anchors(html)).mapInArrow(run, "source string, position int, target string")


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(url, level): pages reached from ``seeds`` (url) over ``edges`` (source, target), level by level until none is new.

    Links are worked out once. Each level joins its new pages with them, leaves out all known pages and keeps its own rows only; lineage is cut by a
    checkpoint per level, and the known pages are put together after every ``JOINED`` levels.
    """
    edges = _kept(edges.select("source", "target").where("source is not null and target is not null").distinct())
    known, fresh = [], _kept(seeds.select("url").distinct().withColumn("level", F.lit(0)))
    for level in count(1):
        known.append(fresh)
        if len(known) > JOINED:
            known = [_kept(reduce(DataFrame.unionByName, known))]
        found = edges.join(fresh.select(F.col("url").alias("source")), "source").select(F.col("target").alias("url")).distinct()
        fresh = _kept(found.join(reduce(DataFrame.unionByName, known).select("url"), "url", "left_anti").withColumn("level", F.lit(level)))
        if fresh.isEmpty():
            return reduce(DataFrame.unionByName, known)
    raise AssertionError


def _kept(df: DataFrame) -> DataFrame:
    from lodestone.sources.shared import checkpoint

    return checkpoint(df)


def crawled(pages: DataFrame, seeds: DataFrame, settings, *, forms: bool = False) -> DataFrame:
    """Documents of a crawl over fetched ``pages`` (url, html): in scope, reached from the seeds, long enough."""
    named = pages.withColumn("canonical_url", urls.canonical("url"))
    inside = named.where(urls.in_scope("canonical_url", forms=forms))
    followed = links(inside.where(urls.follow_links("canonical_url", forms=forms))).select(urls.canonical("source").alias("source"), urls.canonical("target").alias("target"))
    reached = reachable(seeds.select(urls.canonical("url").alias("url")), followed).withColumnRenamed("url", "canonical_url")
    once = inside.join(reached, "canonical_url").withColumn("_n", F.row_number().over(W.partitionBy("canonical_url").orderBy("url"))).where("_n = 1")
    ordered = once.orderBy("level", "canonical_url").limit(settings.max_pages)
    docs = extracted(ordered, key="canonical_url").withColumn("class", urls.source_class("canonical_url"))
    docs = docs.select("canonical_url", "url", "title", "date_modified", "text", "class.*", content_hash("text").alias("content_hash"), word_count("text").alias("word_count"))
    return docs.where((F.col("doc_type") != "buyers_guide") | (F.col("word_count") >= settings.min_guide_words))


def changed(current: DataFrame, previous: DataFrame, *, key: str = "canonical_url", force: bool = False) -> DataFrame:
    """Add ``status``: new, changed or unchanged against the previous manifest."""
    old = previous.select(key, F.col("content_hash").alias("_old"))
    status = F.when(F.col("_old").isNull(), "new").when((F.col("_old") != F.col("content_hash")) | F.lit(force), "changed").otherwise("unchanged")
    return current.join(old, key, "left").withColumn("status", status).drop("_old")


def manifest(documents: DataFrame, order: str, *, key: str = "canonical_url") -> DataFrame:
    """One row per URL, the last one read, sorted by authority and URL."""
    last = documents.groupBy(key).agg(F.max_by(F.struct(*[c for c in documents.columns if c != key]), order).alias("d"))
    return last.select(key, "d.*").orderBy("authority_rank", key)
