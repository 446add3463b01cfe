"""Paged answers of an archive as a Spark data source: a batch reader of known pages and a stream of pages as they come.

    spark.dataSource.register(PagedAnswers)
    spark.read.format("paged").option("url", "https://host/search?start={start}&rows={rows}").option("total", 25000).load()
    spark.readStream.format("paged").option("url", "https://host/list/{page}").load()

Both give page, body, as ``operators.catalog.page_ids`` takes them. Options: ``url`` with {page}, {start} and {rows}; ``pageSize``
(1000), ``total`` (batch only), ``pagesATask`` (10), ``retries`` (5)."""

from __future__ import annotations

import time
from collections.abc import Iterator
from urllib.error import HTTPError, URLError
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "page long, body string"
GONE = (404, 410)


def fetch_page(url: str, page: int, size: int, rows: int, retries: int = 5) -> str | None:
    """The body of one page; None where there is none. Other failures are repeated as ``catalog.retry_delay`` says, then raised."""
    from ..operators.catalog import retry_delay

    at = url.replace("{page}", str(page)).replace("{start}", str(page * size)).replace("{rows}", str(rows))
    for attempt in range(retries + 1):
        try:
            with urlopen(at, timeout=60) as answer:  # noqa: S310
                return answer.read().decode("utf-8", "replace")
        except HTTPError as e:
            if e.code in GONE:
                return None
            wait = retry_delay(attempt, e.code, e.headers.get("Retry-After") if e.headers else None)
        except URLError as e:
            if isinstance(e.reason, FileNotFoundError):
                return None
            wait = retry_delay(attempt, None, None)
        if wait is None or attempt == retries:
            raise OSError(f"page {page} cannot be fetched: {at}")
        time.sleep(wait)
    return None


class Pages(InputPartition):
    """The pages from ``first`` up to ``end``."""

    def __init__(self, first: int, end: int) -> None:
        self.first, self.end = first, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url, self.size = options["url"], int(options.get("pageSize", 1000))
        self.total, self.a_task, self.retries = int(options["total"]), int(options.get("pagesATask", 10)), int(options.get("retries", 5))

    def partitions(self) -> list[Pages]:
        n = -(-self.total // self.size)
        return [Pages(p, min(n, p + self.a_task)) for p in range(0, n, self.a_task)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.end):
            body = fetch_page(self.url, page, self.size, min(self.size, self.total - page * self.size), self.retries)
            if body is not None:
                yield page, body


class _Stream(SimpleDataSourceStreamReader):
    """Pages in order; the offset is the next page. A page that is not there yet is asked for again by the next batch."""

    def __init__(self, options: dict) -> None:
        self.url, self.size = options["url"], int(options.get("pageSize", 1000))
        self.most, self.retries = int(options.get("pagesATask", 10)), int(options.get("retries", 5))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0}

    def _pages(self, first: int, end: int) -> list[tuple]:
        out = []
        for page in range(first, end):
            body = fetch_page(self.url, page, self.size, self.size, self.retries)
            if body is None:
                break
            out.append((page, body))
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = self._pages(start["page"], start["page"] + self.most)
        return iter(found), {"page": start["page"] + len(found)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """The same pages again, after a failure."""
        return iter(self._pages(start["page"], end["page"]))


class PagedAnswers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)
