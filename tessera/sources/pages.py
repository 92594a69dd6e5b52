"""Result pages as a Spark data source: batches of pages as partitions, or as micro-batches of a stream.

    result_pages(spark, client="module:factory", query="...", max_results="100")
    spark.readStream.format("result_pages").options(..., batch_pages="10").load()

``client`` names a function that makes (site, client); it is called in the task that reads pages. The option
``folder`` reads a saved site instead. A batch that fails is read again by Spark's own task retries.

Options: query, page_start and page_end (from 0; the site's last page ends a range), max_results (only the
pages that hold so many results are read), batch_pages (pages read by one task after one search),
batch_sleep_seconds (a task waits so long after its pages, but after the last ones), attempts, pause.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from ..functions.html import FORM_FIELDS, parse_result_page
from .client import FolderClient, SearchSite

SCHEMA = "page int, query string, html string"

#: A form with the hidden fields that a search needs, for a saved site without one (option ``form``).
_FORM = "".join(f'<input type="hidden" name="{name}" value="">' for name in FORM_FIELDS)

#: Tests of a page number against a pushed filter's value.
_TESTS = {
    EqualTo: lambda page, value: page == value, In: lambda page, value: page in value,
    GreaterThan: lambda page, value: page > value, GreaterThanOrEqual: lambda page, value: page >= value,
    LessThan: lambda page, value: page < value, LessThanOrEqual: lambda page, value: page <= value,
}


def result_pages(spark: SparkSession, **options: str) -> DataFrame:
    """The pages of a search; conditions on ``page`` are pushed down, so that other pages are not fetched."""
    spark.dataSource.register(ResultPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("result_pages").options(**options, pushdown="true").load()


def opened(options: dict):
    if "client" in options:
        module, _, name = options["client"].partition(":")
        return getattr(importlib.import_module(module), name)()
    url = options.get("results_url", "https://example.org/Search/Results.aspx")
    return SearchSite(options.get("form_url", "https://example.org/Search/Search.aspx"), url, options.get("query_field", "query")), FolderClient(options["folder"], url, _FORM if "form" in options else None)


class _Batch(InputPartition):
    """Pages of one task; ``held`` has the HTML of those that the plan was made from."""

    def __init__(self, pages: list[int], held: dict[int, str] | None = None, sleep: float = 0.0):
        self.pages, self.held, self.sleep = pages, held or {}, sleep


def _fetch(options: dict, pages: list[int]) -> Iterator[str]:
    site, client = opened(options)
    return site.pages(client, options.get("query", ""), pages, attempts=int(options.get("attempts", 3)), pause=float(options.get("pause", 1)))


def _read(options: dict, batch: _Batch) -> Iterator[tuple]:
    query, missing = options.get("query", ""), [p for p in batch.pages if p not in batch.held]
    fetched = dict(zip(missing, _fetch(options, missing), strict=True)) if missing else {}
    for page in batch.pages:
        yield page, query, batch.held.get(page) or fetched[page]
    time.sleep(batch.sleep)


class ResultPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "result_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_PushedReader if self.options.get("pushdown") == "true" else _Reader)(_Limits(dict(self.options)))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802 - Spark's name
        return _StreamReader(_Limits(dict(self.options)))


class _Limits:
    """The options that say which pages are read, checked."""

    def __init__(self, options: dict):
        self.options = options
        self.first, self.end = int(options.get("page_start", 0)), int(options["page_end"]) if "page_end" in options else None
        self.most = int(options["max_results"]) if "max_results" in options else None
        self.batch, self.sleep = int(options.get("batch_pages", 10)), float(options.get("batch_sleep_seconds", 0))
        if self.first < 0 or (self.end is not None and self.end < self.first):
            raise ValueError("pages must be a range of non-negative numbers")
        if self.most is not None and self.most < 1:
            raise ValueError("the limit must be positive")
        if self.batch < 1 or self.sleep < 0:
            raise ValueError("a batch has one page at least, and its pause must not be negative")

    def first_page(self) -> tuple[str, int]:
        """The HTML of the first page wanted, and the number of the last: that of the site, of the range or
        of the page that holds the last result wanted, whichever is smallest."""
        html = next(_fetch(self.options, [self.first]))
        found = parse_result_page(html, self.options.get("query", ""))
        if not found["results"]:
            raise RuntimeError(f"page {self.first + 1} of the results is empty")
        last = found["total_pages"] - 1
        if self.end is not None:
            last = min(last, self.end)
        if self.most is not None:
            last = min(last, self.first - -self.most // len(found["results"]) - 1)  # only the site's last page is shorter
        return html, max(last, self.first)


class _Reader(DataSourceReader):
    def __init__(self, limits: _Limits):
        self.limits, self.tests = limits, []

    def partitions(self) -> list[InputPartition]:
        html, last = self.limits.first_page()
        pages = [p for p in range(self.limits.first, last + 1) if all(test(p) for test in self.tests)]
        batches = [pages[i : i + self.limits.batch] for i in range(0, len(pages), self.limits.batch)]
        held = {self.limits.first: html}
        return [_Batch(b, {p: held[p] for p in b if p in held}, self.limits.sleep if b is not batches[-1] else 0) for b in batches] or [_Batch([])]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        return _read(self.limits.options, partition)


class _PushedReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("page",):
                self.tests.append(lambda page, f=f: _TESTS[type(f)](page, f.value))
            else:
                yield f


class _StreamReader(DataSourceStreamReader):
    """Offsets are page numbers; a batch takes ``batch_pages`` of them, so a restart goes on where it was.
    The number of pages is asked for once."""

    def __init__(self, limits: _Limits):
        self.limits, self.at, self.last = limits, limits.first, None

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's name
        return {"page": self.limits.first}

    def latestOffset(self) -> dict:  # noqa: N802 - Spark's name
        if self.last is None:
            self.last = self.limits.first_page()[1]
        elif self.at <= self.last:
            time.sleep(self.limits.sleep)
        self.at = min(self.at + self.limits.batch, self.last + 1)
        return {"page": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["page"])
        return [_Batch(list(range(start["page"], end["page"])))]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        return _read(self.limits.options, partition)

    def commit(self, end: dict) -> None:
        pass
