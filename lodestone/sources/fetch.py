"""Fetching pages through a pluggable client, with retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import values as V


class Response(NamedTuple):
    status: int
    final_url: str
    content_type: str
    body: str


#: Makes, within a task, the function that fetches one URL.
Fetcher = Callable[[], Callable[[str, float], Response]]
_OUT = "final_url string, status int, content_type string, html string, error string"


def passing(status: int) -> bool:
    """Whether a status may go away: too many requests, or the server's own failure."""
    return status == 429 or 500 <= status <= 599


def urllib_fetcher() -> Callable[[str, float], Response]:
    """A client of the standard library."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    def get(url: str, timeout: float) -> Response:
        try:
            with urlopen(Request(url, headers={"Accept": "text/html,application/xml"}), timeout=timeout) as r:
                return Response(r.status, r.url, r.headers.get_content_type(), r.read().decode("utf-8", "replace"))
        except HTTPError as error:
            return Response(error.code, url, "", "")

    return get


def fetched(urls: DataFrame, fetcher: Fetcher = urllib_fetcher, *, timeout: float = 45, retries: int = 3, pause: float = 0.2, sleep: Callable[[float], None] = time.sleep, keep: Sequence[str] = ()) -> DataFrame:
    """(url, final_url, status, content_type, html, error) of the distinct ``url``s. A failing page is a row with its error.

    Waits 2, 4, 6, 8, 8, ... seconds before each further try. With ``keep``, columns to keep behind ``url``, the addresses must be
    distinct already and are fetched in the tasks where they lie.
    """
    wanted = urls.select("url", *keep).where("url is not null")
    names = ["url", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = fetcher()

        def one(url: str) -> tuple:
            error = ""
            for attempt in range(1, retries + 1):
                try:
                    r = get(url, timeout)
                    if r.status < 400:
                        return r.final_url, r.status, r.content_type, r.body, None
                    error = f"status {r.status}"
                    if not passing(r.status):
                        break
                except Exception as failure:  # any failure of a page is a row's outcome, not the job's
                    error = f"{type(failure).__name__}: {failure}"
                if attempt < retries:
                    sleep(min(2.0 * attempt, 8.0))
            return None, None, None, None, error

        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                rows.append(one(url))
                sleep(pause)
            kinds = pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, "final_url", "status", "content_type", "html", "error"])

    kinds_ = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields)
    return (wanted if keep else wanted.distinct()).mapInArrow(run, f"{kinds_}, {_OUT}")


def seeds(spark: SparkSession, *, forms: bool = False, directive_html: bool = False) -> DataFrame:
    """The pages at which a crawl begins."""
    site, directive = f"https://{V.PORTAL_HOST}", f"https://{V.DIRECTIVE_HOST}{V.DIRECTIVE_PATH}?id={V.DIRECTIVE_ID}"
    urls = [site + V.GUIDE_PATH, site + V.POLICY_PATH, f"{directive}&section=xml"]
    return spark.createDataFrame([(u,) for u in urls + [site + V.FORMS_PATH] * forms + [directive] * directive_html], "url string")


def failures(pages: DataFrame) -> DataFrame:
    """The crawl's error log."""
    return pages.where(F.col("error").isNotNull()).select("url", "error")
