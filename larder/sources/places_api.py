"""The place search service as a Spark data source: ``spark.read.format("places")``.

Each search text is a partition, so texts are asked in parallel and a failed task
asks again for its own text alone.  The columns of the given schema are the
request's field mask, so the service sends what is read and nothing else.  A
status other than 2xx fails the read with :class:`PlacesError`, or, with the option
``errors`` set to ``rows``, comes out as a row with ``_status`` and ``_error`` (if
the schema has them).  An answer without a list has no places.

Options: ``url``, ``key``, ``queries`` (a JSON list of texts), ``errors``
(``raise`` or ``rows``), ``timeout`` (seconds), ``pages`` (most pages of a text).
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id string, displayName struct<text: string>, formattedAddress string, primaryType string"
FAILURE = ("_query", "_status", "_error")


class PlacesError(RuntimeError):
    """The service refused a request; its status and its own words."""

    def __init__(self, status: int, details: str):
        super().__init__(f"Places request failed with status {status}: {details}")
        self.status, self.details = status, details

    def __reduce__(self):
        return PlacesError, (self.status, self.details)


class Search(InputPartition):
    def __init__(self, text: str):
        super().__init__(text)
        self.text = text


def fitted(value: Any, kind: T.DataType) -> Any:
    """A JSON value as the type asks; other shapes are null."""
    if isinstance(kind, T.StructType):
        return tuple(fitted(value.get(f.name), f.dataType) for f in kind.fields) if isinstance(value, dict) else None
    if isinstance(kind, T.StringType):
        return value if value is None or isinstance(value, str) else json.dumps(value)
    return value


class PlacesReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, dict(options)
        for needed in ("url", "key", "queries"):
            if not self.options.get(needed):
                raise ValueError(f"the option {needed} is missing")
        self.texts = json.loads(self.options["queries"])

    def mask(self) -> str:
        return ",".join([f"places.{f.name}" for f in self.schema.fields if f.name not in FAILURE] + ["nextPageToken"])

    def partitions(self) -> Sequence[Search]:
        return [Search(t) for t in self.texts]

    def _answer(self, text: str, token: str | None) -> dict:
        body = {"textQuery": text} | ({"pageToken": token} if token else {})
        headers = {"Content-Type": "application/json", "X-Goog-Api-Key": self.options["key"], "X-Goog-FieldMask": self.mask()}
        request = urllib.request.Request(self.options["url"], json.dumps(body).encode(), headers, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=float(self.options.get("timeout", 30))) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            raise PlacesError(e.code, e.read().decode("utf-8", "replace")) from None
        except (OSError, ValueError) as e:
            # unreachable, or an answer that isn't JSON
            raise PlacesError(500, f"Failed to fetch places: {e}") from None

    def _row(self, place: dict, **failure: Any) -> tuple:
        return tuple(failure.get(f.name) if f.name in FAILURE else fitted(place.get(f.name), f.dataType) for f in self.schema.fields)

    def read(self, partition: Search) -> Iterator[tuple]:
        token = None
        try:
            for _ in range(int(self.options.get("pages", 3))):
                answer = self._answer(partition.text, token)
                for place in answer.get("places") or []:
                    yield self._row(place, _query=partition.text)
                token = answer.get("nextPageToken")
                if not token:
                    return
        except PlacesError as e:
            if self.options.get("errors", "raise") != "rows":
                raise
            yield self._row({}, _query=partition.text, _status=e.status, _error=e.details)


class PlacesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "places"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> PlacesReader:
        return PlacesReader(schema, self.options)


def search(spark: SparkSession, url: str, key: str, queries: Sequence[str], schema: str = SCHEMA, **options: Any) -> DataFrame:
    """The places that the service finds for all texts."""
    spark.dataSource.register(PlacesSource)
    given = {"url": url, "key": key, "queries": json.dumps(list(queries))} | {k: str(v) for k, v in options.items()}
    return spark.read.format("places").schema(schema).options(**given).load()
