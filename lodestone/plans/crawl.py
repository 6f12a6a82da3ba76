"""A crawl that fetches: rounds of a frontier, each page once, in the order of a queue.

A round is a level of the breadth-first search. Its frontier is dealt to tasks by host, a host to ``connections`` tasks at most, fetched
and parsed there once, and written; the links of what was fetched, less all known pages, are the next frontier. Places in the queue are
numbers that ascend over tasks, so no round is sorted in one task, and only counts come to the driver. Frontiers are the visited set:
they lie in one table, in buckets, behind a Bloom filter of fixed size; only buckets that a link may be in are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import urls
from lodestone.functions import values as V
from lodestone.operators import collect
from lodestone.settings import Settings
from lodestone.sources import fetch
from lodestone.sources.shared import checkpoint, shared_folder

DEFAULTS = Settings()
#: Fetches a frontier (url, place): rows (url, place, final_url, status, content_type, html, error).
Get = Callable[[DataFrame], DataFrame]
#: Visited pages that are compared as they are; of more, those that a Bloom filter lets through.
FEW = 100_000
BUCKETS, FILTER_BITS = 64, 23
_URLS = "url string, place long, level int, bucket int"
#: What becomes of a fetched page. Pages of the last two mark their address as done.
FAILED, OUTSIDE, UNREAD, EMPTY, SHORT, DOCUMENT = "failed", "outside", "parse_failed", "empty", "short", "document"
MARKS = (SHORT, DOCUMENT)


def fetching(fetcher: fetch.Fetcher = fetch.urllib_fetcher, *, connections: int = 4, **options) -> Get:
    """Fetches over the network; the pages of a host are asked for by ``connections`` tasks at most, one after the other in each."""

    def get(frontier: DataFrame) -> DataFrame:
        tasks = int(frontier.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = frontier.repartition(tasks, urls.host(F.col("url")), F.pmod(F.xxhash64("url"), F.lit(connections)))
        return fetch.fetched(dealt, fetcher, keep=("place",), **options)

    return get


def stored(pages: DataFrame) -> Get:
    """Finds pages in a table (url, html) by canonical address; of several the one with the least address."""
    kept = pages.select(urls.canonical("url").alias("_c"), F.col("url").alias("final_url"), "html")
    once = kept.groupBy("_c").agg(F.min_by(F.struct("final_url", "html"), "final_url").alias("p"))

    def get(frontier: DataFrame) -> DataFrame:
        met = frontier.join(once, F.col("url") == F.col("_c"), "left")
        error = F.when(F.col("p").isNull(), "not stored")
        return met.select("url", "place", "p.final_url", F.when(error.isNull(), 200).alias("status"), F.when(error.isNull(), "text/html").alias("content_type"), "p.html", error.alias("error"))

    return get


@dataclass
class Crawl:
    """What a crawl has found; ``rounds`` holds every page that it has asked for."""

    rounds: DataFrame
    seeds: DataFrame
    scope: Callable[[Column], Column]
    visited: int
    levels: int

    def _kept(self) -> DataFrame:
        """Pages up to the first one that marks their address; later ones are the same page again."""
        at = F.struct("level", "place")
        first = self.rounds.where(F.col("outcome").isin(*MARKS)).groupBy("final").agg(F.min(at).alias("_first"))
        return self.rounds.join(first, "final", "left").where(F.col("_first").isNull() | (at <= F.col("_first"))).drop("_first")

    def documents(self) -> DataFrame:
        """(canonical_url, url, title, date_modified, text, doc_type, authority_rank, content_hash, word_count)."""
        names = ("url", "title", "date_modified", "text", "doc_type", "authority_rank", "content_hash", "word_count")
        rows = self._kept().where(F.col("outcome") == DOCUMENT).withColumn("url", F.col("final_url"))
        return rows.select(F.col("final").alias("canonical_url"), *names)

    def errors(self) -> DataFrame:
        """(url, error): pages that could not be fetched, read, or that say nothing."""
        told = F.when(F.col("outcome") == FAILED, "fetch_failed").when(F.col("outcome") == UNREAD, F.concat(F.lit("parse_failed: "), F.coalesce("error", F.lit("")))).when(F.col("outcome") == EMPTY, "empty_text")
        return self.rounds.where(F.col("outcome") == FAILED).unionByName(self._kept().where(F.col("outcome").isin(UNREAD, EMPTY))).select("url", told.alias("error"))

    def skipped(self) -> DataFrame:
        """(url, reason, word_count): guide pages that are too short."""
        return self._kept().where(F.col("outcome") == SHORT).select(F.col("final").alias("url"), F.lit("buyers_guide_too_short").alias("reason"), "word_count")

    def counts(self) -> dict[str, int]:
        links = self._kept().select(F.explode("links").alias("url")).unionByName(self.seeds.select("url"))
        known = links.select(urls.canonical("url").alias("url")).where(self.scope(F.col("url")))
        return {"raw_url_count": links.distinct().count(), "canonical_url_count": known.distinct().count(), "visited_count": self.visited, "document_count": self.documents().count()}


def read(fetched: DataFrame, scope: Callable[[Column], Column], follow: Callable[[Column], Column], settings: Settings = DEFAULTS) -> DataFrame:
    """Fetched pages as documents with their links and outcome; XML is read as a directive, all else as HTML."""
    rows = fetched.withColumn("final", urls.canonical("final_url"))
    inside = F.col("error").isNull() & F.coalesce(scope(F.col("final")), F.lit(False))
    xml = F.col("content_type").contains("xml") | F.col("final").endswith("section=xml")
    hrefs = F.when(inside & F.col("content_type").contains("html") & follow(F.col("final")), collect.anchors("html"))
    rows = rows.select("url", "place", "final_url", "final", "error", inside.alias("inside"), F.coalesce(xml, F.lit(False)).alias("xml"), (urls.host(F.col("final")) == V.PORTAL_HOST).alias("portal"), hrefs.alias("hrefs"), F.when(inside, F.col("html")).alias("html"))
    added = pa.struct([("title", pa.string()), ("date_modified", pa.string()), ("lines", pa.list_(pa.string())), ("links", pa.list_(pa.string())), ("unread", pa.string())])

    def one(final_url: str | None, xml: bool, portal: bool, hrefs, html: str | None) -> dict:
        links = [urljoin(final_url or "", h) for h in hrefs or ()]
        if html is None:
            return {"links": links}
        try:
            title, date, lines = collect.directive_lines(html) if xml else collect.page_parts(html, portal)
            return {"title": title, "date_modified": date, "lines": lines, "links": links}
        except Exception as failure:  # a page that cannot be read is a row's outcome, not the job's
            return {"links": links, "unread": f"{type(failure).__name__}: {failure}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("final_url", "xml", "portal", "hrefs", "html")]
            made = pa.array([one(*row) for row in zip(*columns, strict=True)], added)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], made], names=[*names, "page"])

    names = ["url", "place", "final_url", "final", "error", "inside", "xml"]
    parsed = rows.mapInArrow(run, "url string, place long, final_url string, final string, error string, inside boolean, xml boolean, page struct<title:string,date_modified:string,lines:array<string>,links:array<string>,unread:string>")
    own = F.col("page.lines")
    lines = F.when(F.col("xml"), own).otherwise(collect.deduplicated_lines(F.filter(own, lambda x: ~collect.is_noise(x))))
    parsed = parsed.withColumn("text", collect.normalized_space(F.array_join(lines, "\n"))).withColumn("class", urls.source_class("final"))
    parsed = parsed.withColumn("word_count", collect.word_count("text"))
    outcome = (
        F.when(F.col("error").isNotNull(), FAILED).when(~F.col("inside"), OUTSIDE).when(F.col("page.unread").isNotNull(), UNREAD).when(F.coalesce("text", F.lit("")) == "", EMPTY)
        .when((F.col("class.doc_type") == "buyers_guide") & (F.col("word_count") < settings.min_guide_words), SHORT).otherwise(DOCUMENT)
    )
    return parsed.select(
        "url", "place", "final_url", "final", F.coalesce("error", "page.unread").alias("error"), outcome.alias("outcome"), "page.title", "page.date_modified", "text", "class.doc_type", "class.authority_rank",
        collect.content_hash("text").alias("content_hash"), "word_count", "page.links",
    )


def numbered(rows: DataFrame, pages: int, *order: str) -> DataFrame:
    """The links of ``pages`` pages with ``place``, numbers that ascend in ``order``; those of few pages are sorted in one task, more by ranges."""
    sorted_ = rows.coalesce(1).sortWithinPartitions(*order) if pages <= FEW // 1000 else rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_.withColumn("place", F.monotonically_increasing_id())


def first(frontier: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of the least places; of each task's numbers only the count comes to the driver."""
    part, left = F.shiftright("place", 33), n
    whole, cut = [], None
    for row in frontier.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        if row.n > left:
            cut = row.part
            break
        left -= row.n
        whole.append(row.part)
    mask = (1 << 33) - 1
    return frontier.where(part.isin(*whole) if whole else F.lit(False)) if cut is None else frontier.where((part < cut) | ((part == cut) & (F.col("place").bitwiseAND(F.lit(mask)) < left)))


class Visited:
    """Frontiers in one bucketed table, and a Bloom filter of their addresses once they are many."""

    def __init__(self, spark: SparkSession, folder: str, few: int = FEW) -> None:
        self.spark, self.path, self.bits_path, self.few, self.count = spark, f"{folder}/frontiers", f"{folder}/bits", few, 0
        self.filtered, self.version = 0, 0

    def add(self, rows: DataFrame, level: int) -> DataFrame:
        """Write a frontier (url, place) and read it again."""
        kept = rows.select("url", "place", F.lit(level).alias("level"), F.pmod(F.xxhash64("url"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        kept.write.mode("append").partitionBy("level", "bucket").parquet(self.path)
        return self.level(level)

    def all(self) -> DataFrame:
        return self.spark.read.schema(_URLS).parquet(self.path)

    def level(self, level: int) -> DataFrame:
        return self.all().where(F.col("level") == level).select("url", "place")

    @staticmethod
    def _slots() -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(i), F.col("url")), F.lit(1 << FILTER_BITS)) + 1 for i in range(2)]

    def _bits(self, level: int) -> DataFrame:
        """Rows (part, bits): the filter over all frontiers up to ``level``, made from the last one and the frontiers since."""
        fresh = self.all().where((F.col("level") > self.filtered - 1) & (F.col("level") <= level)).select(F.explode(F.array(*self._slots())).alias("s"))
        parts = fresh.groupBy(F.bitmap_bucket_number("s").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
        if self.version:
            old = self.spark.read.schema("part long, bits binary").parquet(f"{self.bits_path}-{self.version}")
            parts = old.unionByName(parts).groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits"))
        self.version, self.filtered = self.version + 1, level + 1
        parts.write.parquet(f"{self.bits_path}-{self.version}")
        return self.spark.read.schema("part long, bits binary").parquet(f"{self.bits_path}-{self.version}")

    def without(self, rows: DataFrame, level: int) -> DataFrame:
        """``rows`` whose ``url`` is in no frontier up to ``level``."""
        known = self.all().where(F.col("level") <= level).select("url", "bucket")
        if self.count <= self.few:
            return rows.join(F.broadcast(known.select("url")), "url", "left_anti")
        bits = F.broadcast(self._bits(level))  # at most 2 ** FILTER_BITS bits
        names = rows.columns
        rows = rows.withColumn("_maybe", F.lit(True))
        for slot in self._slots():
            at = F.bitmap_bit_position(slot)
            byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            held = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2.0), at % 8)), F.lit(2)) == 1, F.lit(False))
            rows = rows.withColumn("_part", F.bitmap_bucket_number(slot)).join(bits, F.col("_part") == F.col("part"), "left").withColumn("_maybe", F.col("_maybe") & held).select(*names, "_maybe")
        rows = checkpoint(rows.withColumn("_bucket", F.pmod(F.xxhash64("url"), F.lit(BUCKETS)).cast("int")))  # read three times
        maybe = rows.where("_maybe")
        touched = [r[0] for r in maybe.select("_bucket").distinct().collect()]  # at most BUCKETS numbers
        near = known.where(F.col("bucket").isin(*touched)) if touched else known.limit(0)
        met = maybe.join(near.select("url"), "url", "left_anti").select(*names)
        return rows.where("not _maybe").select(*names).unionByName(met)


def crawl(spark: SparkSession, seeds: DataFrame, get: Get | None = None, settings: Settings = DEFAULTS, *, forms: bool = False, directive_html: bool = False, few: int = FEW, scope: Callable[[Column], Column] | None = None, follow: Callable[[Column], Column] | None = None) -> Crawl:
    """Pages reached from ``seeds`` (url, the first ones first), at most ``settings.max_pages`` of them, failed ones included.

    A page's address after redirects must be in scope; links are found before a page is read; a page that was read, or is too
    short, is not read again under another address. ``scope`` and ``follow`` replace the rules for addresses.
    """
    get = get or fetching()
    scope = scope or (lambda u: urls.in_scope(u, forms=forms, directive_html=directive_html))
    follow = follow or (lambda u: urls.follow_links(u, forms=forms))
    folder = f"{shared_folder(spark).rstrip('/')}/crawl-{uuid.uuid4().hex}"
    visited = Visited(spark, folder, few)
    rounds = f"{folder}/rounds"
    start = seeds.select(urls.canonical("url").alias("url"), F.monotonically_increasing_id().alias("place")).where(scope(F.col("url")))
    frontier = visited.add(start.groupBy("url").agg(F.min("place").alias("place")), 0)
    level, schema = 0, None
    n = frontier.count()
    while n and visited.count < settings.max_pages:
        if visited.count + n > settings.max_pages:
            n = settings.max_pages - visited.count
            frontier = first(frontier, n)
        page = read(get(frontier), scope, follow, settings)
        page.write.parquet(f"{rounds}/level={level}")
        schema = T.StructType([*page.schema.fields, T.StructField("level", T.IntegerType())])
        visited.count += n
        every = spark.read.schema(schema).parquet(rounds)
        marks = every.where(F.col("outcome").isin(*MARKS))
        own = every.where((F.col("level") == level) & (F.size("links") > 0))
        before = marks.where(F.col("level") < level).select("final")
        here = marks.where(F.col("level") == level).groupBy("final").agg(F.min("place").alias("_first"))
        fresh = own.join(here, "final", "left").where(F.col("_first").isNull() | (F.col("place") <= F.col("_first"))).join(before, "final", "left_anti")
        found = fresh.select("place", F.posexplode("links").alias("i", "link")).select(urls.canonical("link").alias("url"), "place", "i").where(scope(F.col("url")))
        once = found.groupBy("url").agg(F.min(F.struct("place", "i")).alias("at")).select("url", F.col("at.place").alias("_p"), F.col("at.i").alias("_i"))
        new = visited.without(once, level)
        level += 1
        frontier = visited.add(numbered(new, n, "_p", "_i"), level)
        n = frontier.count()
    none = "url string, place long, final_url string, final string, error string, outcome string, title string, date_modified string, text string, doc_type string, authority_rank int, content_hash string, word_count int, links array<string>, level int"
    every = spark.read.schema(schema).parquet(rounds) if schema is not None else spark.createDataFrame([], none)
    return Crawl(every, seeds, scope, visited.count, level)
