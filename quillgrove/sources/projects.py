"""A source for project search services: one request for each organisation and year."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "project_search"


class Request(InputPartition):
    def __init__(self, organisation: str, year: int):
        self.organisation, self.year = organisation, year


class Reader(DataSourceReader):
    """A partition a request. Where the service is busy, broken or away, that request has no rows."""

    def __init__(self, options: dict[str, str]):
        self.url = options["url"]
        self.limit, self.timeout, self.pause = int(options.get("limit", "200")), float(options.get("timeout", "45")), float(options.get("pause", "10"))
        self.organisations, self.years = json.loads(options["organisations"]), json.loads(options["years"])

    def partitions(self) -> list[Request]:
        return [Request(o, y) for o in self.organisations for y in self.years]

    def read(self, partition: Request) -> Iterator[tuple[str, int, str]]:
        asked = {"criteria": {"fiscal_years": [partition.year], "org_names": [partition.organisation]}, "limit": self.limit, "offset": 0}
        request = urllib.request.Request(self.url, json.dumps(asked).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                found = json.load(answer).get("results", [])
        except urllib.error.HTTPError as e:
            if e.code == 429:
                time.sleep(self.pause)
            return
        except (OSError, ValueError):
            return
        for row in found:
            yield partition.organisation, partition.year, json.dumps(row)


class ProjectSearch(DataSource):
    """Rows (organisation, year, project), the project as JSON; options url, organisations and years (JSON lists), limit, timeout, pause."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "organisation string, year int, project string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options)


def search_projects(spark: SparkSession, url: str, organisations: list[str], years: list[int], limit: int = 200, **options: str) -> DataFrame:
    """(organisation, year, project) of all requests; ``get_json_object`` or ``from_json`` takes a project apart."""
    spark.dataSource.register(ProjectSearch)
    r = spark.read.format(FORMAT).option("url", url).option("organisations", json.dumps(organisations)).option("years", json.dumps(years)).option("limit", str(limit))
    return r.options(**options).load()
