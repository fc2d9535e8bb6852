"""A paginated usage service, replayed from saved pages, as a Spark data source: one partition for each page, and only the pages of the wanted time.

A folder holds the pages as they came, page-<n>.json, and index.jsonl with a line for each page: page, file, first_ms and last_ms of its events,
and has_next. Comparisons of the column ms with a number decide which pages are read; Spark still applies them to the rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..staging import local_path

EVENTS = "page long, pos long, ms long, event string"
LISTS = ("usageEventsDisplay", "usageEvents", "events")
MAX_PAGES = 100_000


class Page(InputPartition):
    def __init__(self, number: int, path: str):
        super().__init__(number)
        self.path = path


class PageReader(DataSourceReader):
    """Pages of a folder whose time meets the pushed bounds."""

    def __init__(self, root: str):
        self.root, self.least, self.most = root.rstrip("/"), None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of ms, for the choice of pages; all filters are left to Spark as well."""
        for f in filters:
            if getattr(f, "attribute", None) == ("ms",) and isinstance(value := getattr(f, "value", None), int):
                if isinstance(f, (GreaterThanOrEqual, GreaterThan, EqualTo)):
                    self.least = max(value + isinstance(f, GreaterThan), value if self.least is None else self.least)
                if isinstance(f, (LessThanOrEqual, LessThan, EqualTo)):
                    self.most = min(value - isinstance(f, LessThan), value if self.most is None else self.most)
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        files, base = local_path(f"{self.root}/index.jsonl")
        with files.open_input_file(base) as f:
            index = [json.loads(line) for line in f.read().splitlines() if line.strip()]
        index.sort(key=lambda p: p["page"])
        if len(index) > MAX_PAGES:
            raise ValueError(f"more than {MAX_PAGES} pages")
        if [p["page"] for p in index] != list(range(1, len(index) + 1)) or (index and index[-1].get("has_next")):
            raise ValueError("pages are missing; partial data are refused")
        inside = [p for p in index if p["first_ms"] is not None and (self.least is None or p["last_ms"] >= self.least) and (self.most is None or p["first_ms"] <= self.most)]
        return [Page(p["page"], f"{self.root}/{p['file']}") for p in inside]

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition is None:  # no page is wanted
            return
        files, base = local_path(partition.path)
        with files.open_input_file(base) as f:
            found = json.loads(f.read())
        events = found if isinstance(found, list) else next((found[x] for x in LISTS if isinstance(found.get(x), list)), None)
        if events is None:
            raise ValueError(f"no list of events in {partition.path}")
        for pos, event in enumerate(events):
            yield partition.value, pos, event.get("timestamp"), json.dumps(event)


class BillingPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "billing_pages"

    def schema(self) -> str:
        return EVENTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(self.options["path"])


def is_crawl(spark: SparkSession, root: str) -> bool:
    """Whether a root holds saved pages."""
    from .base import text_files

    text = text_files(spark, f"{root}/index.jsonl", "index.jsonl")
    return text is not None and bool(text.inputFiles())


def events(spark: SparkSession, root: str) -> DataFrame:
    """The events of saved pages."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BillingPages)
    return spark.read.format("billing_pages").load(root)
