"""Paged table services as a data source: key ranges are partitions, each read page by page in its task.

    spark.dataSource.register(PagedSource)
    spark.read.format("pages").schema("id long, name string").option("url", "http://host/table").load()

A service answers ``GET url?column=gt.5&order=id.asc&limit=1000`` with a JSON list of objects, as
table services over HTTP do. Options: ``url``; ``key`` (default ``id``), a column of integers
that rises and is unique; ``pageSize`` (1000); ``partitions`` (8), ranges of equal width between
the smallest and the largest key; ``retries`` (3) a page, ``wait`` seconds before the first of
them (0.5), doubled each time; ``timeout`` (60); ``header.NAME`` for headers such as keys.

With ``pushFilters`` comparisons of columns with values are passed on to the service; Spark
wants ``spark.sql.python.filterPushdown.enabled`` for that. As a stream, the source gives rows whose key is
larger than that of all rows given before; ``startingKey`` says after which to begin.

Defined results: an empty table has no rows and no partitions; columns that a row lacks are
null; a page that fails ``retries`` times more fails the task, whose next attempt reads its
range again from the beginning; rows that come while a range is read are in it if their key is.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
)

COMPARISONS = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "gte", LessThan: "lt", LessThanOrEqual: "lte"}


@dataclass
class KeyRange(InputPartition):
    """Keys above ``after``, up to ``last``."""

    after: int
    last: int


class _Service:
    """Requests to the service, and rows of the schema."""

    def __init__(self, schema: T.StructType, options: Mapping[str, str]):
        if "url" not in options:
            raise ValueError("option url is missing")
        self.schema, self.url, self.key = schema, options["url"], options.get("key", "id")
        self.size, self.partitions = int(options.get("pagesize", 1000)), int(options.get("partitions", 8))
        self.retries, self.wait, self.timeout = int(options.get("retries", 3)), float(options.get("wait", 0.5)), float(options.get("timeout", 60))
        self.headers = {k.removeprefix("header."): v for k, v in options.items() if k.startswith("header.")}
        self.filters: list[tuple[str, str]] = []
        if self.size < 1 or self.partitions < 1:
            raise ValueError("pageSize and partitions are 1 or more")

    def page(self, *conditions: tuple[str, str], order: str = "asc", limit: int | None = None) -> list[dict]:
        wanted = dict.fromkeys([f.name for f in self.schema] + [self.key])
        query = urllib.parse.urlencode([("select", ",".join(wanted)), *self.filters, *conditions, ("order", f"{self.key}.{order}"), ("limit", str(limit or self.size))])
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(f"{self.url}?{query}", headers=self.headers), timeout=self.timeout) as answer:
                    rows = json.load(answer)
                if not isinstance(rows, list):
                    raise ValueError("the service didn't answer with a list")
                return rows
            except (OSError, ValueError) as e:
                # what the service refuses it will refuse again, but for too many requests
                if attempt == self.retries or isinstance(e, urllib.error.HTTPError) and 400 <= e.code < 500 and e.code not in (408, 429):
                    raise
                time.sleep(self.wait * 2**attempt)
        raise AssertionError

    def ends(self, *conditions: tuple[str, str]) -> tuple[int, int] | None:
        """The smallest and the largest key."""
        first, last = (self.page(*conditions, order=o, limit=1) for o in ("asc", "desc"))
        return (int(first[0][self.key]), int(last[0][self.key])) if first and last else None

    def ranges(self, low: int, high: int) -> list[KeyRange]:
        """Above ``low``, up to ``high``."""
        n = min(self.partitions, high - low)
        cuts = [low + (high - low) * i // n for i in range(n + 1)] if n > 0 else []
        return [KeyRange(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def rows(self, keys: KeyRange | None) -> Iterator[tuple]:
        if keys is None:  # of a table without partitions
            return
        at = keys.after
        while at < keys.last:
            page = self.page((self.key, f"gt.{at}"), (self.key, f"lte.{keys.last}"))
            for r in page:
                yield tuple(_value(r.get(f.name), f.dataType) for f in self.schema)
            if len(page) < self.size:
                return
            at = int(page[-1][self.key])


def _value(x: object, kind: T.DataType) -> object:
    if x is None:
        return None
    if isinstance(kind, T.StringType):
        return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    if isinstance(kind, T.IntegralType):
        return int(x)
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return float(x)
    if isinstance(kind, T.DateType):
        return dt.date.fromisoformat(x)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return dt.datetime.fromisoformat(x)
    return x


class PagedReader(DataSourceReader):
    def __init__(self, service: _Service):
        self.service = service

    def partitions(self) -> list[KeyRange]:
        ends = self.service.ends()
        return self.service.ranges(ends[0] - 1, ends[1]) if ends else []

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        return self.service.rows(partition)


class FilteringReader(PagedReader):
    """A reader that has the service filter."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            plain = isinstance(value, int | float | str) and not isinstance(value, bool)
            if name and type(f) in COMPARISONS and plain:
                self.service.filters.append((name, f"{COMPARISONS[type(f)]}.{value}"))
            elif name and isinstance(f, In) and f.value and all(isinstance(v, int) and not isinstance(v, bool) for v in f.value):
                self.service.filters.append((name, f"in.({','.join(map(str, f.value))})"))
            elif name and isinstance(f, IsNull | IsNotNull):
                self.service.filters.append((name, "is.null" if isinstance(f, IsNull) else "not.is.null"))
            else:
                yield f


class PagedStreamReader(DataSourceStreamReader):
    """Offsets are {"key": the largest key so far}."""

    def __init__(self, service: _Service, start: int):
        self.service, self.start = service, start

    def initialOffset(self) -> dict:  # noqa: N802
        return {"key": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        ends = self.service.ends()
        return {"key": max(self.start, ends[1]) if ends else self.start}

    def partitions(self, start: dict, end: dict) -> list[KeyRange]:
        return self.service.ranges(start["key"], end["key"])

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        return self.service.rows(partition)


class PagedSource(DataSource):
    """The format ``pages``; it has the schema that the user gives."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        raise ValueError("a paged source needs a schema")

    def reader(self, schema: T.StructType) -> PagedReader:
        service = _Service(schema, self.options)
        return FilteringReader(service) if self.options.get("pushfilters", "false").lower() == "true" else PagedReader(service)

    def streamReader(self, schema: T.StructType) -> PagedStreamReader:  # noqa: N802
        return PagedStreamReader(_Service(schema, self.options), int(self.options.get("startingkey", -1)))
