"""Landed pages as a data source: ``spark.read.format("landed")`` and ``spark.readStream.format("landed")``.

A crawl lands its pages under ``path/source_key=KEY/run=N/`` in files of JSON lines, {"page": 1, "body": "..."}, each file
sorted by page; the folder of a run appears when the run is whole. Each run of a source is a partition. Its pages are checked
first, so that a run gives all its items or, where a page is broken or missing, one row with the error: a broken page fails
its run and nothing else. The stream's offset is the last run read of each source.

How a source pages is data (``specs``, a JSON list): key, items (path of the list in a body, "" for the body itself), stop and at
(path of the number or mark that the rule looks at). Rules:

- ``pages``: ``at`` is the number of pages; - ``rows``: ``at`` is the number of rows of the whole list (skip and limit, or offsets
by rows received); - ``next``: ``at`` is empty on the last page (next address, opaque cursor, a mark that there is more);
- ``short``: a page has fewer rows than ``size``; - ``empty``: a page has no rows.

Pages after the one where the rule stops aren't read. Files are opened with pyarrow's file systems (file, s3, gs, hdfs).
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source_key string, run int, page int, place int, item string, error string"
#: Of a rule: does this page end the list? told: what the body says at ``at``; page: pages so far; rows: rows so far; n: rows of the page.
STOPS = {
    "pages": lambda told, page, rows, n, size: told is not None and page >= int(told),
    "rows": lambda told, page, rows, n, size: told is not None and rows >= int(told),
    "next": lambda told, page, rows, n, size: told in (None, "", False),
    "short": lambda told, page, rows, n, size: n < size,
    "empty": lambda told, page, rows, n, size: n == 0,
}


@dataclass
class Run(InputPartition):
    source_key: str
    run: int


def value_at(body, path: str):
    """The value at a dotted path; null where a step is missing."""
    for step in path.split(".") if path else ():
        body = body.get(step) if isinstance(body, dict) else None
    return body


class _Landing:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.specs = {s["key"]: s for s in json.loads(options["specs"])}
        if unknown := {s.get("stop") for s in self.specs.values()} - set(STOPS):
            raise ValueError(f"unknown stop rules: {sorted(map(str, unknown))}")

    def _fs(self):
        return fs.FileSystem.from_uri(self.path)

    def runs(self) -> dict[str, list[int]]:
        """Numbers of the landed runs of every source that has a spec."""
        store, root = self._fs()
        out: dict[str, list[int]] = {}
        for key in self.specs:
            found = store.get_file_info(fs.FileSelector(f"{root}/source_key={key}", allow_not_found=True))
            out[key] = sorted(int(m[1]) for f in found if f.type == fs.FileType.Directory and (m := re.fullmatch(r"run=(\d+)", f.base_name)))
        return out

    def _pages(self, part: Run) -> Iterator[tuple[int, str]]:
        store, root = self._fs()
        folder = store.get_file_info(fs.FileSelector(f"{root}/source_key={part.source_key}/run={part.run}"))
        files = sorted(f.path for f in folder if f.is_file and not f.base_name.startswith(("_", ".")))

        def lines(path):
            with store.open_input_stream(path) as data:
                rest = b""
                while block := data.read(1 << 20):
                    *whole, rest = (rest + block).split(b"\n")
                    yield from map(json.loads, whole)
                if rest.strip():
                    yield json.loads(rest)

        for row in heapq.merge(*map(lines, files), key=lambda r: r["page"]):
            yield row["page"], row["body"]

    def _items(self, part: Run) -> Iterator[tuple[int, list]]:
        """Pages and their items up to the stop; raises ValueError where the run isn't whole."""
        spec, rows, number = self.specs[part.source_key], 0, 0
        for page, text in self._pages(part):
            number += 1
            if page != number:
                raise ValueError(f"page {number} is missing")
            try:
                body = json.loads(text)
            except (TypeError, json.JSONDecodeError) as wrong:
                raise ValueError(f"page {page}: {wrong}") from None
            items = value_at(body, spec.get("items", ""))
            if not isinstance(items, list):
                raise ValueError(f"page {page} has no list of items")
            rows += len(items)
            yield page, items
            if STOPS[spec["stop"]](value_at(body, spec.get("at", "")) if spec.get("at") else None, number, rows, len(items), spec.get("size", 0)):
                return
        raise ValueError(f"the list goes on after page {number}")

    def read(self, part: Run) -> Iterator[tuple]:
        try:
            for _ in self._items(part):
                pass
        except (ValueError, KeyError) as wrong:
            yield part.source_key, part.run, None, None, None, str(wrong)
            return
        for page, items in self._items(part):
            for place, item in enumerate(items):
                yield part.source_key, part.run, page, place, json.dumps(item, ensure_ascii=False), None


class LandedReader(_Landing, DataSourceReader):
    def partitions(self) -> list[Run]:
        return [Run(k, n) for k, numbers in self.runs().items() for n in numbers]


class LandedStream(_Landing, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {k: numbers[-1] for k, numbers in self.runs().items() if numbers}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        return [Run(k, n) for k, numbers in self.runs().items() for n in numbers if start.get(k, -1) < n <= end.get(k, -1)]


class Landed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options)

    def streamReader(self, schema) -> LandedStream:
        return LandedStream(self.options)


def _opened(reader, spark: SparkSession, path: str, specs: list[dict], keys: Iterable[str] | None):
    spark.dataSource.register(Landed)
    some = [s for s in specs if keys is None or s["key"] in set(keys)]
    return reader.format("landed").option("path", path).option("specs", json.dumps(some)).load()


def read(spark: SparkSession, path: str, specs: list[dict], keys: Iterable[str] | None = None) -> DataFrame:
    """All landed runs, or those of some sources: the choice is made here, before files are listed.

    Filters aren't pushed down to the reader: Spark 4.1 keeps what one plan pushed with the DataFrame, and a second plan over
    the same DataFrame would lack the rows that the first one left out.
    """
    return _opened(spark.read, spark, path, specs, keys)


def read_stream(spark: SparkSession, path: str, specs: list[dict], keys: Iterable[str] | None = None) -> DataFrame:
    return _opened(spark.readStream, spark, path, specs, keys)
