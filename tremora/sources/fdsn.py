"""A Python data source for FDSN event services, with partitions planned by counts.

One Spark partition is one bounded request: the planner halves time, and below a day the box, until the service
counts no more than the cap. Requests run on the executors and are retried there.
"""

from __future__ import annotations

import json
import math
import time as clock
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tremora.operators import revisions
from tremora.sources import geojson

SCHEMA = "feature string"
LIMIT, CAP, DEPTH = 20_000, 18_000, 40
SHORTEST = timedelta(days=1)
LEAST_MAGNITUDE = -2.0
RETRIES, BACKOFF_S, TIMEOUT_S = 3, 1.0, 60
TRANSIENT = {429, 500, 502, 503, 504}


@dataclass(frozen=True)
class EventQuery(InputPartition):
    """Half-open in time, closed in space."""

    start: datetime
    end: datetime
    south: float = -90.0
    north: float = 90.0
    west: float = -180.0
    east: float = 180.0
    minimum_magnitude: float = 0.0

    def __post_init__(self) -> None:
        if (self.start.tzinfo is None) != (self.end.tzinfo is None):
            raise ValueError("both times need a zone, or neither")
        if self.start >= self.end or self.south > self.north or self.west > self.east:
            raise ValueError("a query needs ordered bounds")
        if not (-90 <= self.south and self.north <= 90 and -180 <= self.west and self.east <= 180):
            raise ValueError("bounds must lie on the globe")
        if not (math.isfinite(self.minimum_magnitude) and self.minimum_magnitude >= LEAST_MAGNITUDE):
            raise ValueError(f"the least magnitude must be a number from {LEAST_MAGNITUDE} on")

    def parameters(self) -> dict[str, str]:
        return {
            "format": "geojson",
            "starttime": self.start.isoformat(),
            "endtime": self.end.isoformat(),
            "minlatitude": str(self.south),
            "maxlatitude": str(self.north),
            "minlongitude": str(self.west),
            "maxlongitude": str(self.east),
            "minmagnitude": str(self.minimum_magnitude),
            "eventtype": "earthquake",
            "orderby": "time-asc",
        }


def plan(query: EventQuery, count: Callable[[EventQuery], int], cap: int = CAP, depth: int = DEPTH) -> list[EventQuery]:
    """Queries of at most cap events that cover query, in order of time and place. Empty ones are left out."""
    n = count(query)
    if n < 0:
        raise ValueError("a count can't be negative")
    if n <= cap:
        return [query] if n else []
    if depth == 0:
        raise ValueError("the service counts too many events in the smallest query")
    if query.end - query.start > SHORTEST:
        middle = query.start + max(SHORTEST, (query.end - query.start) / 2)
        parts = [replace(query, end=middle), replace(query, start=middle)]
    else:
        lat, lon = (query.south + query.north) / 2, (query.west + query.east) / 2
        parts = [
            replace(query, south=s, north=n, west=w, east=e)
            for s, n in ((query.south, lat), (lat, query.north))
            for w, e in ((query.west, lon), (lon, query.east))
        ]
    return [q for p in parts for q in plan(p, count, cap, depth - 1)]


def months(start_year: int, end_year: int) -> list[tuple[datetime, datetime]]:
    """Half-open months of inclusive years."""
    firsts = [datetime(y, m, 1) for y in range(start_year, end_year + 1) for m in range(1, 13)] + [datetime(end_year + 1, 1, 1)]
    return list(zip(firsts, firsts[1:]))


def fetch(url: str, opener=urlopen, sleep=clock.sleep, retries: int = RETRIES) -> bytes:
    """The response body; transient failures are retried with growing pauses, others raised at once."""
    for attempt in range(retries + 1):
        try:
            with opener(url, timeout=TIMEOUT_S) as response:
                return response.read()
        except HTTPError as error:
            if error.code not in TRANSIENT or attempt == retries:
                raise
        except URLError:
            if attempt == retries:
                raise
        sleep(BACKOFF_S * 2**attempt)
    raise AssertionError("unreachable")


def pages(base: str, query: EventQuery, get: Callable[[str], bytes], limit: int = LIMIT) -> Iterator[str]:
    """Features of all pages as JSON text; a short page is the last, a page seen before is an error."""
    offset, before = 1, None
    while True:
        body = get(f"{base}/query?{urlencode(query.parameters() | {'limit': limit, 'offset': offset})}")
        features = json.loads(body)["features"]
        ids = [f.get("id") for f in features]
        if ids and ids == before:
            raise ValueError("the service repeats a page")
        yield from (json.dumps(f) for f in features)
        if len(features) < limit:
            return
        offset, before = offset + limit, ids


def single(base: str, query: EventQuery, get: Callable[[str], bytes], limit: int = LIMIT) -> list[str]:
    """Features of one request as JSON text. As many as the limit may be cut off, and are an error."""
    features = json.loads(get(f"{base}/query?{urlencode(query.parameters() | {'limit': limit})}"))["features"]
    if len(features) >= limit:
        raise ValueError(f"{query.start} to {query.end} reaches the limit of {limit} events; ask for less")
    return [json.dumps(f) for f in features]


def monthly(query: EventQuery) -> list[EventQuery]:
    """The query in calendar months."""
    spans = ((max(a, query.start.replace(tzinfo=None)), min(b, query.end.replace(tzinfo=None))) for a, b in months(query.start.year, query.end.year))
    return [replace(query, start=a, end=b) for a, b in spans if a < b]


class FdsnReader(DataSourceReader):
    """Option by says what a partition is: planned (the default) by counts and read in pages; month or whole: one
    request, which fails at the service's limit."""

    def __init__(self, options: dict[str, str]):
        self.base = options["url"].rstrip("/")
        self.by = options.get("by", "planned")
        if self.by not in ("planned", "month", "whole"):
            raise ValueError("by must be planned, month or whole")
        self.query = EventQuery(
            datetime.fromisoformat(options["start"]),
            datetime.fromisoformat(options["end"]),
            *(float(options.get(k, d)) for k, d in (("south", -90), ("north", 90), ("west", -180), ("east", 180), ("minimummagnitude", 0))),
        )

    def partitions(self) -> list[EventQuery]:
        if self.by != "planned":
            return [self.query] if self.by == "whole" else monthly(self.query)

        def count(q: EventQuery) -> int:
            return int(json.loads(fetch(f"{self.base}/count?{urlencode(q.parameters())}"))["count"])

        return plan(self.query, count)

    def read(self, partition: EventQuery) -> Iterator[tuple[str]]:
        found = pages(self.base, partition, fetch) if self.by == "planned" else single(self.base, partition, fetch)
        for feature in found:
            yield (feature,)


class FdsnSource(DataSource):
    """spark.dataSource.register(FdsnSource); spark.read.format("fdsn").option("url", ...).option("start", ...)"""

    @classmethod
    def name(cls) -> str:
        return "fdsn"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FdsnReader:
        return FdsnReader(dict(self.options))


def download(spark: SparkSession, url: str, query: EventQuery, by: str = "planned") -> DataFrame:
    """The events of all partitions as one catalog: the newest revision of each, sorted by time, id and source."""
    spark.dataSource.register(FdsnSource)
    options = {"url": url, "by": by, "start": query.start.isoformat(), "end": query.end.isoformat()}
    options |= {k: str(getattr(query, k)) for k in ("south", "north", "west", "east")} | {"minimummagnitude": str(query.minimum_magnitude)}
    features = spark.read.format("fdsn").options(**options).load()
    typed = features.select(F.from_json("feature", geojson.feature_type()).alias("feature"))
    return revisions.winners(geojson.parse_strict(typed)).orderBy("time", "event_id", "source")
