"""Research sources: their configuration and citations, and a data source of pinned files.

A pin is an address and the git blob checksum of what must lie there. One Spark partition is one pin; a reader fetches it
on the executor and gives no row unless the checksum is right, so nothing unverified reaches a table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tremora.sources import boundaries, geojson
from tremora.sources.fdsn import fetch
from tremora.sources.verified import blob_sha1, download_verified

#: Public files of the fault database and of the boundary steps, as sections of a configuration.
DEFAULTS: dict[str, dict[str, dict[str, Any]]] = {
    "faults": {
        "gem_global_active_faults": {
            "role": "global_active_fault_context",
            "raw_url": "https://raw.githubusercontent.com/GEMScienceTools/gem-global-active-faults/master/geojson/gem_active_faults.geojson",
            "observed_git_blob_sha": "f7a62707792e2b6d99412108bf1496d45bad51f7",
            "license": "CC-BY-SA-4.0",
            "citation": {"type": "dataset", "title": "GEM Global Active Faults Database"},
        }
    },
    "plate_boundaries": {
        "bird_pb2002": {
            "role": "global_plate_boundary_context",
            "raw_url": "https://raw.githubusercontent.com/fraxen/tectonicplates/339b0c56563c118307b1f4542703047f5f698fae/original/PB2002_steps.dat.txt",
            "observed_git_blob_sha": "b48506d79c614b241ce26cf949492ee7c6676d60",
            "distribution_license": "ODC-By-1.0",
            "citation": {"type": "journal_article_and_supplementary_dataset", "title": "An updated digital model of plate boundaries", "doi": "10.1029/2001GC000252"},
        }
    },
}
GEM, PB2002 = ("faults", "gem_global_active_faults"), ("plate_boundaries", "bird_pb2002")
#: What a citation record takes over from the configuration, where it is there.
PROVENANCE = (
    "version", "release_date", "doi", "license", "distribution_license", "distribution_commit", "version_of_record_path", "observed_git_blob_sha",
)


class SourceError(ValueError):
    """A source that isn't configured, or whose content isn't what it must be."""


def load_sources(spark: SparkSession, path: str | None = None) -> Mapping[str, Any]:
    """The configuration: an object of sections of named sources; by default the pins of this module."""
    if path is None:
        return DEFAULTS
    lines = spark.read.text(path, wholetext=True).collect()  # one small file
    try:
        found = json.loads(lines[0]["value"]) if lines else None
    except json.JSONDecodeError as error:
        raise SourceError(f"{path} is no JSON") from error
    if not isinstance(found, dict):
        raise SourceError(f"{path} must hold an object")
    return found


def source(sources: Mapping[str, Any], section: str, key: str) -> Mapping[str, Any]:
    """The configuration of one source; an error if there is none."""
    held = sources.get(section)
    found = held.get(key) if isinstance(held, dict) else None
    if not isinstance(found, dict):
        raise SourceError(f"source not configured: {section}.{key}")
    return found


def citation(sources: Mapping[str, Any], section: str, key: str) -> dict[str, Any]:
    """What a study says of a source: its key, role, citation and provenance."""
    found = source(sources, section, key)
    if not isinstance(found.get("citation"), dict):
        raise SourceError(f"no citation: {section}.{key}")
    record = {"source_key": key, "role": found.get("role"), "citation": dict(found["citation"])}
    return record | {f: found[f] for f in PROVENANCE if found.get(f) not in (None, "")}


@dataclass(frozen=True)
class Pin(InputPartition):
    """A name, an address and a checksum."""

    name: str
    url: str
    sha: str

    def __post_init__(self) -> None:
        if not self.url.strip() or len(self.sha) != 40:
            raise SourceError(f"{self.name or 'a pin'} needs an address and a checksum of 40 digits")

    def content(self, get: Callable[[str], bytes] = fetch) -> bytes:
        found = get(self.url)
        if blob_sha1(found) != self.sha.lower():
            raise SourceError(f"{self.url} has checksum {blob_sha1(found)}, not {self.sha.lower()}")
        return found


def pin(sources: Mapping[str, Any], section: str, key: str) -> Pin:
    """The pin of a configured source; an error if it lacks its address or checksum."""
    found = source(sources, section, key)
    try:
        return Pin(key, str(found["raw_url"]), str(found["observed_git_blob_sha"]))
    except KeyError as error:
        raise SourceError(f"incomplete source: {section}.{key} lacks {error.args[0]}") from error


def feature_collection(content: bytes) -> dict[str, Any]:
    """The object in GeoJSON bytes; an error if they hold anything but a collection of features."""
    try:
        found = json.loads(content.decode("utf-8"))
    except ValueError as error:
        raise SourceError("not UTF-8 JSON") from error
    if not isinstance(found, dict) or found.get("type") != "FeatureCollection":
        raise SourceError("not a FeatureCollection")
    return found


class PinnedReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.kind = options.get("kind", "lines")
        if self.kind not in ("lines", "features"):
            raise SourceError("kind must be lines or features")
        self.pins = [Pin(*x) for x in json.loads(options["pins"])]

    def partitions(self) -> list[Pin]:
        return self.pins

    def read(self, partition: Pin) -> Iterator[tuple[str, str]]:
        content = partition.content()
        if self.kind == "lines":
            rows = content.decode("utf-8").splitlines()
        else:
            rows = map(json.dumps, feature_collection(content).get("features") or [])
        for row in rows:
            yield partition.name, row


class PinnedSource(DataSource):
    """spark.dataSource.register(PinnedSource); rows (name, value): lines, or features as JSON text, of pinned files."""

    @classmethod
    def name(cls) -> str:
        return "pinned"

    def schema(self) -> str:
        return "name string, value string"

    def reader(self, schema) -> PinnedReader:
        return PinnedReader(dict(self.options))


def read_pinned(spark: SparkSession, pins: list[Pin], kind: str = "lines") -> DataFrame:
    """(name, value) of pinned files. A wrong or missing one fails the job."""
    spark.dataSource.register(PinnedSource)
    said = json.dumps([(p.name, p.url, p.sha) for p in pins])
    return spark.read.format("pinned").option("kind", kind).option("pins", said).load()


def pinned_steps(spark: SparkSession, sources: Mapping[str, Any] = DEFAULTS) -> DataFrame:
    """The boundary steps of the pinned file."""
    return boundaries.parse_steps(read_pinned(spark, [pin(sources, *PB2002)]).select("value"))


def pinned_faults(spark: SparkSession, sources: Mapping[str, Any] = DEFAULTS) -> DataFrame:
    """The fault traces of the pinned collection."""
    return geojson.parse_faults(read_pinned(spark, [pin(sources, *GEM)], "features").select(F.col("value").alias("feature")))


def download_geojson(url: str, expected: str, target: Path, get: Callable[[str], bytes] = fetch) -> Path:
    """A pinned collection of features as a local file, written only if checksum and content are right."""

    def checked(address: str) -> bytes:
        content = Pin(target.name, address, expected).content(get)
        feature_collection(content)
        return content

    return download_verified(url, expected.lower(), target, checked)


def download_faults(target: Path, sources: Mapping[str, Any] = DEFAULTS, get: Callable[[str], bytes] = fetch) -> Path:
    found = pin(sources, *GEM)
    return download_geojson(found.url, found.sha, target, get)


def download_steps(target: Path, sources: Mapping[str, Any] = DEFAULTS, get: Callable[[str], bytes] = fetch) -> Path:
    found = pin(sources, *PB2002)
    return download_verified(found.url, found.sha.lower(), target, get)
