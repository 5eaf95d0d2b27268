"""A batch source over paged JSON answers, by the Python data source API.

``spark.read.format("pagedjson").option("pages", folder)`` reads the answers of
a service that were stored as ``<folder>/<name>.json``; each ``next`` link names
the following page. A chain is read to its end; with ``most_pages`` a longer
one fails. The network part of a service is a ``fetch`` that may be
replaced by a subclass.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["pages"]
        self.starts = [s for s in options.get("starts", "first").split(",") if s]
        most = options.get("most_pages")
        self.most = None if most is None else int(most)

    def partitions(self) -> list[InputPartition]:
        """One per start page: chains are read side by side."""
        return [InputPartition(s) for s in self.starts]

    def fetch(self, name: str) -> str | None:
        path = os.path.join(self.folder, f"{name}.json")
        if not os.path.exists(path):
            return None
        with open(path, encoding="utf-8") as f:
            return f.read()

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name, no, seen = partition.value, 0, set()
        while name and name not in seen:
            if no == self.most:
                raise ValueError(f"{partition.value}: more than {self.most} pages")
            seen.add(name)
            body = self.fetch(name)
            if body is None:
                return
            no += 1
            yield partition.value, no, body
            try:
                name = json.loads(body).get("next")
            except (ValueError, AttributeError):
                return


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pagedjson"

    def schema(self) -> str:
        return "url string, page int, json string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
