"""Catalog files: readers and writers by suffix, the region-partitioned store, and batch updates of it."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.operators import revisions
from tremora.operators.lineage import cut, fits
from tremora.operators.validation import query_filter, utc_time, within_box
from tremora.sources import commits
from tremora.sources.schemas import CATALOG, CATALOG_COLUMNS, EXPORT_COLUMNS, OBSERVATORY

TIMES = ("time", "updated_at", "event_time_utc", "updated_time_utc")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A CSV, JSON-lines, ORC or Parquet catalog by suffix, its time columns parsed, other columns as they are."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        df = spark.read.csv(path, header=True, nullValue="")
    elif suffix in ("parquet", "orc"):
        df = spark.read.format(suffix).load(path)
    elif suffix in ("json", "jsonl"):
        df = spark.read.json(path)
    else:
        raise ValueError(f"unsupported catalog format: {suffix}")
    return df.withColumns({c: utc_time(F.col(c)) for c in TIMES if c in df.columns})


def write_catalog(df: DataFrame, path: str) -> None:
    """Write by suffix, as a folder of part files. One file is for small exports only: see export_csv."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in ("csv", "parquet", "orc", "json"):
        raise ValueError(f"unsupported catalog format: {suffix}")
    writer = df.write.mode("overwrite")
    if suffix == "csv":
        writer = writer.option("header", True)
    writer.format(suffix).save(path)


def exported(df: DataFrame) -> DataFrame:
    """The export columns in order; sorted so that equal catalogs give equal files."""
    return df.withColumnRenamed("updated_at", "updated_time").select(*EXPORT_COLUMNS).orderBy("time", "event_id", "source")


def export_csv(df: DataFrame, path: str) -> None:
    """One file if the catalog is small enough for one task; else files that follow each other in order."""
    rows = exported(df)
    (rows.coalesce(1) if fits(df) else rows).write.mode("overwrite").option("header", True).csv(path)


def export_parquet(df: DataFrame, path: str) -> None:
    exported(df).write.mode("overwrite").parquet(path)


def to_observatory(df: DataFrame) -> DataFrame:
    """The catalog under the names that daily metrics read."""
    return df.select(*(F.col(old).alias(new) for new, old in OBSERVATORY.items())).orderBy("event_time_utc", "event_id", "source")


def latest_catalog(spark: SparkSession, folder: str, pattern: str = "*_earthquakes.parquet") -> str:
    """The newest file of a folder by modification time; the path also tells between equals."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    best = files.agg(F.max(F.struct("modificationTime", "path")).alias("f")).first()["f"]
    if best is None:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return best["path"]


NO_MONTH = "none"
#: Buckets of the index from keys to months, and the parts of it that are read together before they are made one.
BUCKETS, PARTS = 64, 16
#: Times that an upsert is merged anew because another writer changed the same events meanwhile.
ATTEMPTS = 20
INDEX = "hash long, source string, event_id string, month string, bucket int"


def _month(time: str = "time") -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM"), F.lit(NO_MONTH))


def _hashed(df: DataFrame) -> DataFrame:
    """df with the hash of its key and the bucket of that."""
    return df.withColumn("hash", F.xxhash64("source", "event_id")).withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)).cast("int"))


def _same_key(a: str, b: str) -> Column:
    held = [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in revisions.KEY]
    return (F.col(f"{a}.hash") == F.col(f"{b}.hash")) & held[0] & held[1]


class Conflict(RuntimeError):
    """Other writers came first, again and again."""


@dataclass(frozen=True)
class Snapshot:
    """One version of a region: (folder, rows) of each month, and the parts of the index, older ones first."""

    version: int
    months: dict[str, tuple[str, int]]
    index: tuple[str, ...]


@dataclass(frozen=True)
class CatalogStore:
    """Catalogs in Parquet by region and month, with an index from keys to months.

    Files are never changed. A writer makes new ones and then adds the next version, a list of the files that count, by
    a rename that fails if that version exists already. So a failure leaves the old catalog as it was, and of two
    writers the second notices: it adds its months to the first one's version if they share neither months nor events,
    and merges anew otherwise. On an object store without such a rename there must be one writer.
    """

    spark: SparkSession
    root: str

    def path(self, region: str) -> str:
        return f"{self.root}/region={region_key(region)}"

    def _versions(self, region: str) -> str:
        return f"{self.path(region)}/versions"

    def snapshot(self, region: str) -> Snapshot:
        """The newest version; version 0 has nothing."""
        version = commits.newest(self.spark, self._versions(region))
        if not version:
            return Snapshot(0, {}, ())
        schema = "kind string, name string, folder string, rows long, place int"
        rows = self.spark.read.schema(schema).json(commits.numbered(self._versions(region), version)).collect()  # months, and PARTS at most
        months = {r["name"]: (r["folder"], r["rows"]) for r in sorted(rows, key=lambda r: r["name"] or "") if r["kind"] == "month"}
        return Snapshot(version, months, tuple(r["folder"] for r in sorted(rows, key=lambda r: r["place"]) if r["kind"] == "index"))

    def months(self, region: str) -> dict[str, str]:
        """Folder of each month that has events, in order of time: as many entries as months."""
        return {m: f for m, (f, _) in self.snapshot(region).months.items()}

    def _publish(self, region: str, made: Snapshot) -> bool:
        """Add a version; False if another writer has added that one already."""
        lines = [{"kind": "month", "name": m, "folder": f, "rows": n, "place": 0} for m, (f, n) in made.months.items()]
        lines += [{"kind": "index", "name": "", "folder": f, "rows": 0, "place": k} for k, f in enumerate(made.index)]
        text = "".join(json.dumps(x) + "\n" for x in lines)
        return commits.publish(self.spark, commits.numbered(self._versions(region), made.version), text, self._rename)

    def _rename(self, source, target) -> None:
        commits.rename(self.spark, source, target)

    def _write(self, region: str, df: DataFrame) -> dict[str, tuple[str, int]]:
        """New files for the months of df, and their rows."""
        folder = f"{self.path(region)}/files-{uuid4().hex}"
        # One shuffle by month and day, so that a month is several files and a task holds few months.
        dealt = df.select(*CATALOG_COLUMNS, _month().alias("month")).repartition("month", F.dayofmonth("time"))
        dealt.sortWithinPartitions("month", "time", "event_id", "source").write.partitionBy("month").parquet(folder)
        names = {n.removeprefix("month="): f"{folder}/{n}" for n in commits.listed(self.spark, folder) if n.startswith("month=")}
        if not names:
            return {}
        counts = self.spark.read.schema(f"{CATALOG}, month string").parquet(folder).groupBy("month").count().collect()  # months
        return {r["month"]: (names[r["month"]], r["count"]) for r in counts}

    def _write_index(self, region: str, rows: DataFrame) -> str:
        """A part of the index: rows(source, event_id, month) by bucket, in order of their hashes."""
        folder = f"{self.path(region)}/index-{uuid4().hex}"
        dealt = _hashed(rows.select("source", "event_id", "month")).repartition("bucket")
        dealt.sortWithinPartitions("bucket", "hash").write.partitionBy("bucket").parquet(folder)
        return folder

    def _indexed(self, folders: tuple[str, ...], buckets: list[int] | None = None) -> DataFrame:
        """(hash, source, event_id, month) of the index, the newest month of each key."""
        parts = [self.spark.read.schema(INDEX).parquet(f).withColumn("place", F.lit(k)) for k, f in enumerate(folders)]
        both = reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], f"{INDEX}, place int"))
        if buckets is not None:
            both = both.where(F.col("bucket").isin(buckets))
        return both.groupBy("hash", *revisions.KEY).agg(F.max_by("month", "place").alias("month"))

    def _events(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(CATALOG).parquet(*folders) if folders else self.spark.createDataFrame([], CATALOG)

    def load(self, region: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Events with start <= time < end; empty where the region has none. Only months within the bounds are listed,
        and both bounds reach the scan."""
        # A day either way, as a bound's time zone need not be the session's.
        first = (start - timedelta(1)).strftime("%Y-%m") if start else None
        last = (end + timedelta(1)).strftime("%Y-%m") if end else None
        df = self._events(
            [
                f for m, f in self.months(region).items()
                if m == NO_MONTH or ((first is None or m >= first) and (last is None or m <= last))
            ]
        )
        if start is not None:
            df = df.where(F.col("time") >= F.lit(start))
        return df if end is None else df.where(F.col("time") < F.lit(end))

    def save(self, region: str, df: DataFrame) -> None:
        """Replace the catalog of a region; df may read from it. Of two saves the later one counts."""
        written = self._write(region, df)
        index = self._write_index(region, self._events([f for f, _ in written.values()]).withColumn("month", _month()))
        for _ in range(ATTEMPTS):
            if self._publish(region, Snapshot(self.snapshot(region).version + 1, written, (index,))):
                return
        raise Conflict(region)

    def upsert(self, region: str, incoming: DataFrame) -> dict[str, int]:
        """Merge by newest revision; returns inserted, updated, unchanged and final_count.

        The index tells in which months the incoming events are. Only those and the months that they come with are read
        and written; a batch reads buckets of the index, never the whole catalog.
        """
        new = cut(_hashed(revisions.winners(incoming.select(*CATALOG_COLUMNS))))
        buckets = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        for _ in range(ATTEMPTS):
            base = self.snapshot(region)
            # Keys of the batch alone, so a small table.
            had = new.alias("n").join(self._indexed(base.index, buckets).alias("i"), _same_key("n", "i"))
            had = cut(had.select("n.hash", "n.source", "n.event_id", "i.month"))
            names = had.select("month").unionByName(new.select(_month().alias("month"))).distinct()
            touched = {r["month"] for r in names.collect()}  # months
            old = self._events([f for m, (f, _) in base.months.items() if m in touched])
            merged = cut(revisions.merge(old, new.select(*CATALOG_COLUMNS)))
            counts = revisions.merge_counts(old, new.select(*CATALOG_COLUMNS)).first().asDict()
            written = self._write(region, merged)
            mine = _hashed(merged).alias("m").join(new.alias("n"), _same_key("m", "n"), "left_semi").withColumn("month", _month())
            moved = mine.alias("m").join(had.alias("h"), _same_key("m", "h") & (F.col("m.month") == F.col("h.month")), "left_anti")
            part = self._write_index(region, moved)
            rest = {m: x for m, x in base.months.items() if m not in touched}
            if self._commit(region, base, touched, written, part, new, buckets):
                apart = sum(n for _, n in rest.values())
                return counts | {"unchanged": counts["unchanged"] + apart, "final_count": counts["final_count"] + apart}
        raise Conflict(region)

    def _commit(self, region, base, touched, written, part, new, buckets) -> bool:
        """Add a version with the months and the index part of an upsert; False if it must be merged anew."""
        seen = base
        while True:
            months = {m: x for m, x in seen.months.items() if m not in touched} | written
            index = (*seen.index, part)
            if len(index) > PARTS:
                index = (self._write_index(region, self._indexed(index)),)
            if self._publish(region, Snapshot(seen.version + 1, months, index)):
                return True
            seen = self.snapshot(region)
            added = tuple(f for f in seen.index if f not in base.index)
            if any(seen.months.get(m) != base.months.get(m) for m in touched):
                return False
            if not self._indexed(added, buckets).alias("i").join(new.alias("n"), _same_key("i", "n"), "left_semi").isEmpty():
                return False

    def vacuum(self, region: str) -> None:
        """Delete files and versions that no longer count; for when nobody reads or writes."""
        now = self.snapshot(region)
        used = {f.rsplit("/", 2)[-2] for f, _ in now.months.values()} | {f.rsplit("/", 1)[-1] for f in now.index}
        stale = [f"{self.path(region)}/{n}" for n in commits.listed(self.spark, self.path(region)) if n != "versions" and n not in used]
        versions = self._versions(region)
        kept = commits.numbered(versions, now.version)
        stale += [f for n in commits.listed(self.spark, versions) if (f := f"{versions}/{n}") != kept]
        for name in stale:
            commits.remove(self.spark, name)

    def update(self, region: str, incoming: DataFrame, start: datetime, end: datetime, box: tuple[float, float, float, float] | None = None, minimum_magnitude: float | None = None) -> DataFrame:
        """Merge what the query selects of incoming into the store; returns the counts of the merge."""
        read = cut(incoming)
        counts = self.upsert(region, query_filter(read, start, end, box, minimum_magnitude)) | {"downloaded": read.count()}
        names = ("inserted", "updated", "unchanged", "final_count", "downloaded")
        return self.spark.createDataFrame([tuple(counts[n] for n in names)], ", ".join(f"{n} long" for n in names))


@dataclass(frozen=True)
class Region:
    key: str
    name: str
    box: tuple[float, float, float, float]
    minimum_magnitude: float = 0.0

    def select(self, df: DataFrame) -> DataFrame:
        return df.where(within_box(F.col("latitude"), F.col("longitude"), *self.box))


def region_key(name: str) -> str:
    """Lower case, with underscores for spaces and dashes."""
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def infer_region(stem: str, regions: dict[str, Region], default: str) -> str:
    """The longest key that a file's stem starts with, followed by an underscore."""
    fitting = [k for k in regions if stem.startswith(f"{k}_")]
    return max(fitting, key=len) if fitting else default


def load_regions(spark: SparkSession, path: str) -> dict[str, Region]:
    """Regions from JSON lines of key, name, south, north, west, east and minimum_magnitude. A list for people."""
    schema = "key string, name string, south double, north double, west double, east double, minimum_magnitude double"
    rows = spark.read.schema(schema).json(path).collect()
    return {
        region_key(r["key"]): Region(region_key(r["key"]), r["name"], (r["south"], r["north"], r["west"], r["east"]), r["minimum_magnitude"] or 0.0)
        for r in rows
    }


def region_dictionary(spark: SparkSession, path: str) -> tuple[dict[str, Region], str]:
    """(enabled regions by key, the default one) from one JSON object {default_region, regions: {key: {name, bounds:
    {min_latitude, max_latitude, min_longitude, max_longitude}, default_minimum_magnitude, enabled}}}. An error if a
    bound is missing or no number, if bounds are out of order, or if the default isn't among them."""
    lines = spark.read.text(path, wholetext=True).collect()  # one small file
    said = json.loads(lines[0]["value"]) if lines else {}
    listed = said.get("regions") if isinstance(said, dict) else None
    if not isinstance(listed, dict) or not listed:
        raise ValueError(f"{path} has no dictionary of regions")
    found = {}
    for name, held in listed.items():
        try:
            if not held.get("enabled", True):
                continue
            south, north, west, east = (float(held["bounds"][f"{end}_{axis}"]) for axis in ("latitude", "longitude") for end in ("min", "max"))
        except (AttributeError, KeyError, TypeError, ValueError) as error:
            raise ValueError(f"region {name}: incomplete bounds") from error
        if not (-90 <= south < north <= 90 and -180 <= west < east <= 180):
            raise ValueError(f"region {name}: bounds out of order")
        key = region_key(name)
        found[key] = Region(key, held.get("name") or name, (south, north, west, east), float(held.get("default_minimum_magnitude") or 0.0))
    default = region_key(said.get("default_region") or next(iter(found), ""))
    if default not in found:
        raise ValueError(f"the default region {default} is not among the enabled ones")
    return found, default
