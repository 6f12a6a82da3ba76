"""Structural chunking of documents into overlapping windows of whole blocks.

The packing of blocks restarts from data-dependent places, so each document is folded by itself in
Python; documents are independent and never leave their partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.settings import Settings

DEFAULTS = Settings()
# The form of numbered headings and steps.
_HEADING = re.compile(r"(?:step\s+\d+[:.]?|(?:\d+(?:\.\d+)+|\d+)\s+.+)\Z", re.IGNORECASE)
_LIST_LINE = re.compile(r"\s*(?:[-*+] |\d\d\.)")
_FENCE = re.compile(r"\s*(```|~~~)")


def kind_of(line: str) -> str:
    """blank, fence, table, list or plain."""
    if not line.strip():
        return "blank"
    if _FENCE.match(line):
        return "fence"
    if line.count("|") >= 2:
        return "table"
    return "list" if _LIST_LINE.match(line) else "plain"


def heading_of(block: str) -> str | None:
    """The block's first line if it reads as a section title."""
    line = block.partition("\n")[0].strip()
    titled = len(line.split()) <= 12 and line[:1].isupper() and not line.endswith(".")
    return line if line and (_HEADING.match(line) or titled) else None


def blocks_of(lines: list[str]) -> Iterator[str]:
    """Fences, tables, lists and paragraphs in order."""
    kinds = [kind_of(line) for line in lines]
    at = 0
    while at < len(lines):
        begin, kind = at, kinds[at]
        at += 1
        if kind == "blank":
            continue
        if kind == "fence":
            mark = lines[begin].strip()[:3]
            at += sum(1 for _ in takewhile(lambda x: not x.strip().startswith(mark), lines[at:]))
            at = min(len(lines), at + 1)  # with its closing line
        else:
            goes_on = {
                "table": lambda i: kinds[i] == "table",
                "list": lambda i: kinds[i] in ("blank", "list") or lines[i].startswith("  "),
                "plain": lambda i: kinds[i] == "plain",
            }[kind]
            while at < len(lines) and goes_on(at):
                at += 1
        yield "\n".join(lines[begin:at])


def pieces_of(block: str, most: int) -> Iterator[str]:
    """A block of more than ``most`` characters cut between lines; a long line stays whole."""
    held: list[str] = []
    size = -1
    for line in block.split("\n") if len(block) > most else [block]:
        if held and size + 1 + len(line) > most:
            yield "\n".join(held)
            held, size = [], -1
        held.append(line)
        size += 1 + len(line)
    yield "\n".join(held)


@dataclass
class _Window:
    blocks: list[str]
    size: int = 0

    def fits(self, block: str, most: int) -> bool:
        return not self.blocks or self.size + 2 + len(block) <= most

    def add(self, block: str) -> None:
        self.size += len(block) + 2 * bool(self.blocks)
        self.blocks.append(block)

    def tail(self, overlap: int) -> _Window:
        """A new window with the fewest last blocks that reach ``overlap`` characters."""
        kept, total = 0, 0
        while overlap > 0 and kept < len(self.blocks) and total < overlap:
            kept += 1
            total += len(self.blocks[-kept])
        out = _Window([])
        for block in self.blocks[len(self.blocks) - kept :]:
            out.add(block)
        return out


def chunks_of(text: str, most: int, overlap: int) -> list[tuple[str, str]]:
    """(section title, text) of each chunk."""
    body = text.replace("\r\n", "\n").strip()
    out: list[tuple[str, str]] = []
    window, title = _Window([]), ""

    def flush() -> None:
        joined = "\n\n".join(window.blocks).strip()
        if joined:
            out.append((title, joined))

    for block in (p for b in blocks_of(body.split("\n")) for p in pieces_of(b, most)) if body else ():
        if not window.fits(block, most):
            flush()
            window = window.tail(overlap)
        window.add(block)
        title = heading_of(block) or title
    if window.blocks:
        flush()
    return out


def chunked(documents: DataFrame, *, key: str = "stem", text: str = "body", carry: tuple[str, ...] = (), settings: Settings = DEFAULTS) -> DataFrame:
    """One row per chunk: ``carry``, chunk_id (``key__n``), chunk_no, section_title and text.

    Null and blank texts give no chunks.
    """
    source = documents.select(*carry, F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    n = len(carry)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:n]]
    names = [*carry, "chunk_id", "chunk_no", "section_title", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, key_, no, title, chunk) for i, (key_, text_) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True))
                    for no, (title, chunk) in enumerate(chunks_of(text_ or "", settings.chunk_chars, settings.chunk_overlap))]
            take = pa.array([r[0] for r in rows], pa.int64())
            own = [pa.array([f"{r[1]}__{r[2]}" for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(i).take(take) for i in range(n)] + own, names=names)

    return source.mapInArrow(run, ", ".join([*fields, "chunk_id string", "chunk_no int", "section_title string", "text string"]))


def retrieval_text(metadata: bool = False) -> Column:
    """The text that is embedded, with a header of what is known about the chunk if ``metadata``."""
    if not metadata:
        return F.col("text")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    line = lambda name, c: F.when(said(c), F.concat(F.lit(f"{name}: "), F.col(c).cast("string")))
    title = F.coalesce(line("TITLE", "source_title"), line("TITLE", "title"))
    rank = F.when(F.col("authority_rank") != 0, F.concat(F.lit("AUTHORITY_RANK: "), F.col("authority_rank").cast("string")))
    head = F.concat_ws("\n", line("DOC_TYPE", "doc_type"), title, line("SECTION", "section_title"), rank)
    return F.when(head == "", F.col("text")).otherwise(F.concat(head, F.lit("\n\n"), F.col("text")))
