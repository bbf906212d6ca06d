"""Pages fetched over HTTP, many at a time in each task. Where pages are in a table already, this is not needed."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMEOUT, CONCURRENT, HEADERS = 25, 4, {"Accept-Language": "ru,en"}


def get(url: str) -> str | None:
    """The text of a page, redirects followed; null unless its status is 200."""
    with urllib.request.urlopen(urllib.request.Request(url, headers=HEADERS), timeout=TIMEOUT) as r:
        if r.status != 200:
            return None
        return r.read().decode(r.headers.get_content_charset() or "utf-8", errors="replace")


def fetch_pages(urls: DataFrame, url_col: str = "page_url", fetch: Callable[[str], str | None] = get, concurrent: int = CONCURRENT) -> DataFrame:
    """``urls`` with html, error_code and error_message. A page that fails is a row with an error, not a failed job."""

    def one(url: str | None) -> tuple[str | None, str | None, str | None]:
        try:
            html = fetch(url) if url else None
        except Exception as e:  # whatever a server or a client does wrong is a result
            return None, "fetch_exception", str(e)[:200]
        return (html, None, None) if html else (None, "fetch_failed", "No HTML returned")

    names = urls.columns
    at = names.index(url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrent) as pool:
            for batch in batches:
                for k in range(0, batch.num_rows, 16 * concurrent):
                    part = batch.slice(k, 16 * concurrent)
                    got = list(pool.map(one, part.column(at).to_pylist()))
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([g[c] for g in got], pa.string()) for c in range(3))], [*names, "html", "error_code", "error_message"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return urls.mapInArrow(run, f"{schema}, html string, error_code string, error_message string")


def with_fallback(pages: DataFrame, by_url: DataFrame, url_col: str = "page_url") -> DataFrame:
    """Pages whose text comes from a table (``url``, ``html``) instead of the network."""
    known = by_url.select(F.col("url").alias("__url"), "html")
    return pages.join(known, F.col(url_col) == F.col("__url"), "left").drop("__url")
