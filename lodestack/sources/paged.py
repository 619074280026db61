"""A paged HTTP archive as a Spark data source over an injected fetcher, to be read at once or as a stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lodestack.sources.documents import paged

Fetch = Callable[[int, int], tuple[int, list[dict]]]


class Pages(InputPartition):
    """Pages first to last of an archive whose size is known; without numbers, all there are."""

    def __init__(self, first: int | None = None, last: int | None = None):
        super().__init__((first, last))
        self.first, self.last = first, last


def _dealt(first: int, last: int, per_task: int) -> list[Pages]:
    return [Pages(k, min(last, k + per_task - 1)) for k in range(first, last + 1, per_task)]


def _read(fetch: Fetch, part: Pages, per_page: int) -> Iterator[tuple]:
    for number in range(part.first, part.last + 1):
        status, rows = fetch(number, per_page)
        if status != 200:
            raise RuntimeError(f"page {number} gave status {status}")
        for row in rows:
            yield number, json.dumps(row)


def paged_source(fetch: Fetch, name: str = "paged", total: Callable[[], int] | None = None) -> type[DataSource]:
    """A data source class to register: one row (page, json) for each object of the archive.

    fetch: (page from 1, per_page) -> (status, objects); total: how many objects the archive has now. Without it, whether there
    is a next page shows only when one is read, so the archive is one partition, and there is no stream; with it, pages are
    read by many tasks, and a page that fails raises. Options: per_page, max_pages, pages_per_task.

    A stream counts full pages: an offset is the number of pages read so far, each micro-batch reads those that have filled up
    since, and a restart goes on behind the last committed one, so no page is read twice by finished batches. Objects of the
    last page wait until it is full. The archive has to be sorted by age, oldest first, so that pages do not shift."""

    class Reader(DataSourceReader):
        def __init__(self, per_page: int, most: int, per_task: int):
            self.per_page, self.most, self.per_task = per_page, most, per_task

        def partitions(self) -> list[Pages]:
            if total is None:
                return [Pages()]
            return _dealt(1, min(self.most, -(-total() // self.per_page)), self.per_task)

        def read(self, partition: Pages) -> Iterator[tuple]:
            if partition.first is not None:
                yield from _read(fetch, partition, self.per_page)
                return
            for number, rows in enumerate(paged(fetch, self.per_page, self.most), start=1):
                for row in rows:
                    yield number, json.dumps(row)

    class Stream(DataSourceStreamReader):
        def __init__(self, per_page: int, per_task: int):
            self.per_page, self.per_task = per_page, per_task

        def initialOffset(self) -> dict:
            return {"pages": 0}

        def latestOffset(self) -> dict:
            return {"pages": total() // self.per_page}

        def partitions(self, start: dict, end: dict) -> list[Pages]:
            return _dealt(start["pages"] + 1, end["pages"], self.per_task)

        def read(self, partition: Pages) -> Iterator[tuple]:
            return _read(fetch, partition, self.per_page)

        def commit(self, end: dict) -> None:
            pass  # the archive keeps its pages

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "page int, json string"

        def _number(self, key: str, default: int) -> int:
            return int(self.options.get(key, str(default)))

        def reader(self, schema) -> DataSourceReader:
            return Reader(self._number("per_page", 100), self._number("max_pages", 50), self._number("pages_per_task", 1))

        def streamReader(self, schema) -> DataSourceStreamReader:
            if total is None:
                raise ValueError("an archive without a known size cannot be read as a stream")
            return Stream(self._number("per_page", 100), self._number("pages_per_task", 1))

    return Paged
