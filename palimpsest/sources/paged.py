"""A store that answers in pages, as a Spark data source.

Each partition is a run of pages, so pages are fetched side by side, and a task that is lost
fetches its own pages again.  Only the columns of the schema that is asked for are requested, so a
store's vectors stay where they are; equality filters on the scope go to the store; a scan can
begin at an offset that an earlier one reached.

A store is named by an importable function: ``fetch(offset, limit, columns, scope)`` gives rows as
dictionaries, ``count(scope)`` their number.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

PAGE, RUN = 256, 16


@dataclass
class Pages(InputPartition):
    first: int
    last: int


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.columns = [f.name for f in schema.fields]
        self.store, self.key = options["store"], options.get("scopecolumn", "")
        self.page, self.run = int(options.get("page", PAGE)), int(options.get("run", RUN))
        self.offset, self.scope = int(options.get("offset", 0)), options.get("scope")

    def _of(self, name: str) -> Any:
        module, _, prefix = self.store.partition(":")
        return getattr(importlib.import_module(module), prefix + name)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """An equality on the scope's column is the store's; the rest is Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (self.key,) and self.scope in (None, f.value):
                self.scope = f.value
            else:
                yield f

    def partitions(self) -> list[Pages]:
        rows = self._of("count")(self.scope)
        step = self.page * self.run
        return [Pages(at, min(at + step, rows)) for at in range(self.offset, rows, step)] or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        fetch = self._of("fetch")
        for at in range(partition.first, partition.last, self.page):
            for row in fetch(at, min(self.page, partition.last - at), self.columns, self.scope):
                yield tuple(row.get(c) for c in self.columns)


class Paged(DataSource):
    """format("paged"): options store (module:prefix), page, run (pages of a partition), offset, scopeColumn."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("state the columns that are wanted as the schema of the scan")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Paged)
