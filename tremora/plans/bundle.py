"""Named outputs: catalog files, the activity report, and study bundles that can be written, opened and studied again."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.operators import daily, interaction
from tremora.operators.lineage import cut
from tremora.plans.dashboard import BUNDLE_VERSION
from tremora.sources import commits

#: Tables that a bundle needs before its along-boundary study can be run again.
NEEDED = ("events", "boundary_associations", "steps")
ALONG_TABLES = ("along_pairs", "along_windows", "along_strata", "along_rings", "along_coverage")


def finite(value: Column) -> Column:
    """A number from text; null for empty text, for what is no number, and for what isn't finite."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def whole(value: Column) -> Column:
    """The integer part of a finite number."""
    return finite(value).try_cast("long")


def flag(value: Column) -> Column:
    """Whether a text says yes; anything else, null included, is no."""
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes"), F.lit(False))


def iso_time(value: Column) -> Column:
    """A T in place of the first space, if there is none; null for empty text."""
    spaced = F.contains(value, F.lit(" ")) & ~F.contains(value, F.lit("T"))
    return F.when(F.length(value) > 0, F.when(spaced, F.regexp_replace(value, "^([^ ]*) ", "$1T")).otherwise(value))


def catalog_stem(region: str, first_year: int, last_year: int) -> str:
    return f"{region}_{first_year}_{last_year}_earthquakes"


def write_catalog_files(df: DataFrame, summary: DataFrame, stem: str, raw: str, processed: str) -> dict[str, str]:
    """The catalog as JSON lines with times as text under raw, and as CSV and Parquet under processed, with its summary."""
    times = {c: F.col(c).cast("string") for c, kind in df.dtypes if kind.startswith("timestamp")}
    paths = {
        "raw": f"{raw}/{stem}.json",
        "csv": f"{processed}/{stem}.csv",
        "parquet": f"{processed}/{stem}.parquet",
        "summary": f"{processed}/{stem}_summary.json",
    }
    df.withColumns(times).write.mode("overwrite").json(paths["raw"])
    df.write.mode("overwrite").option("header", True).csv(paths["csv"])
    df.write.mode("overwrite").parquet(paths["parquet"])
    summary.write.mode("overwrite").json(paths["summary"])
    return paths


def write_activity_report(catalog: DataFrame, folder: str, name: str) -> dict[str, str]:
    """Daily activity with its rolling columns as CSV, and the summary of the days as JSON."""
    days = cut(daily.daily_activity(catalog))
    paths = {"daily_activity": f"{folder}/{name}_daily_activity.csv", "summary": f"{folder}/{name}_activity_summary.json"}
    daily.rolling_activity(days).write.mode("overwrite").option("header", True).csv(paths["daily_activity"])
    daily.activity_summary(days).write.mode("overwrite").json(paths["summary"])
    return paths


@dataclass(frozen=True)
class Bundle:
    """One version of a bundle: the folder of each table, and what is known of the study."""

    number: int
    tables: dict[str, str]
    metadata: dict[str, Any]


def _versions(folder: str) -> str:
    return f"{folder}/versions"


def current(spark: SparkSession, folder: str) -> Bundle:
    """The newest version. A folder of tables beside a metadata.json, as write_tables and write_metadata make it, is
    version 0."""
    number = commits.newest(spark, _versions(folder))
    if number:
        said = json.loads(spark.read.text(commits.numbered(_versions(folder), number)).collect()[0]["value"])  # one line
        return Bundle(number, {n: f"{folder}/{at}" for n, at in said["tables"].items()}, said["metadata"])
    if not commits.exists(spark, f"{folder}/metadata.json"):
        raise FileNotFoundError(f"{folder} lacks metadata.json")
    names = [n for n in commits.listed(spark, folder) if n.endswith(".parquet")]
    rows = spark.read.text(f"{folder}/metadata.json").collect()  # written as one row
    return Bundle(0, {n.removesuffix(".parquet"): f"{folder}/{n}" for n in names}, json.loads(rows[0]["value"]))


def commit(spark: SparkSession, folder: str, base: Bundle | None, tables: dict[str, DataFrame], metadata: dict[str, Any]) -> Bundle:
    """The next version of a bundle: new tables beside those of base, which stay as they are.

    Tables are written to a folder of their own first. Only when all are there is the list of what counts published, in
    one step, so readers see the old version or the new one. Another writer's version in between is an error.
    """
    inside = f"tables-{uuid4().hex}"
    write_tables(tables, f"{folder}/{inside}")
    held = {n: path.removeprefix(f"{folder}/") for n, path in base.tables.items()} if base else {}
    held |= {n: f"{inside}/{n}.parquet" for n in tables}
    number = base.number + 1 if base else 1
    text = json.dumps({"tables": held, "metadata": metadata}, sort_keys=True)
    if not commits.publish(spark, commits.numbered(_versions(folder), number), text):
        raise RuntimeError(f"another version {number} of {folder} was written meanwhile")
    return Bundle(number, {n: f"{folder}/{at}" for n, at in held.items()}, metadata)


def write_metadata(spark: SparkSession, folder: str, metadata: dict[str, Any]) -> None:
    """One small row of JSON text, for a folder of plain tables."""
    row = spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{folder}/metadata.json")


def read_metadata(spark: SparkSession, folder: str) -> dict[str, Any]:
    return current(spark, folder).metadata


def _flat(df: DataFrame) -> DataFrame:
    """df with nested columns as JSON text."""
    return df.withColumns({c: F.to_json(c) for c, kind in df.dtypes if kind.startswith(("array", "struct", "map"))})


def write_tables(tables: dict[str, DataFrame], folder: str, csv: bool = False) -> None:
    """Tables as Parquet, and as CSV too where asked for; nested columns are JSON text in CSV."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        if csv:
            _flat(df).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def export_tables(spark: SparkSession, folder: str, target: str, names: Iterable[str] | None = None, kind: str = "csv") -> list[str]:
    """Tables of the newest version as CSV or JSON under target; returns their paths."""
    if kind not in ("csv", "json"):
        raise ValueError("tables are exported as csv or json")
    held, made = current(spark, folder).tables, []
    for name in sorted(held) if names is None else names:
        df = spark.read.parquet(held[name])
        made.append(f"{target}/{name}.{kind}")
        writer = (_flat(df) if kind == "csv" else df).write.mode("overwrite")
        writer.option("header", True).csv(made[-1]) if kind == "csv" else writer.json(made[-1])
    return made


def open_bundle(spark: SparkSession, folder: str, needed: Iterable[str] = NEEDED, version: int | None = None) -> dict[str, DataFrame]:
    """The needed tables of a bundle; a missing one, or another schema version than asked for, is an error."""
    found = current(spark, folder)
    for name in needed:
        if name not in found.tables:
            raise FileNotFoundError(f"{folder} lacks {name}")
    schema = found.metadata.get("bundle_schema_version")
    if version is not None and schema != version:
        raise ValueError(f"bundle of version {schema}, not {version}")
    return {n: spark.read.parquet(found.tables[n]) for n in needed}


def read_exported(spark: SparkSession, folder: str, schemas: dict[str, str], kind: str = "csv") -> dict[str, DataFrame]:
    """Tables that export_tables wrote, with the given columns: numbers that aren't finite become null, flags are read
    from text, empty text is null. All tables must be there; one that lacks a column is an error."""
    found = {}
    for name, columns in schemas.items():
        path = f"{folder}/{name}.{kind}"
        if not commits.exists(spark, path):
            raise FileNotFoundError(f"{folder} lacks {name}.{kind}")
        wanted = [c.split() for c in columns.split(", ")]
        reader = spark.read.option("header", True).option("nullValue", "")
        read = reader.csv(path) if kind == "csv" else reader.option("primitivesAsString", True).json(path)
        if missing := [c for c, _ in wanted if c not in read.columns]:
            raise ValueError(f"{name} lacks {', '.join(missing)}")
        casts = {"double": finite, "long": whole, "boolean": flag}
        found[name] = read.select(*(casts.get(t, lambda c, t=t: c.cast(t))(F.col(n)).alias(n) for n, t in wanted))
    return found


ASSOCIATIONS = (
    "event_id string, step_id string, boundary_id string, left_plate string, right_plate string, boundary_class string,"
    " polarity string, distance_km double, source string"
)


def read_associations_csv(spark: SparkSession, path: str) -> DataFrame:
    """Boundary associations from CSV. Only empty fields are null: NA is a plate."""
    return spark.read.schema(ASSOCIATIONS).option("header", True).option("nullValue", "").option("enforceSchema", False).csv(path)


def restudy_along(spark: SparkSession, folder: str, minimum_magnitude: float = 6.0, **limits: float) -> dict[str, Any]:
    """Run the along-boundary study of a stored bundle again, add its tables and bring the metadata up to date.

    The metadata needs the profile's start and end. All new tables and the metadata become visible in one step, so a
    failure anywhere leaves the old version, which can be read all the while.
    """
    base, kept = current(spark, folder), open_bundle(spark, folder)
    start, end = (F.to_timestamp(F.lit(base.metadata["profile"][k])) for k in ("start", "end"))
    bounds = spark.range(1).select(start.alias("s"), end.alias("e")).first()
    events, plates, steps = (kept[n] for n in NEEDED)
    pairs = cut(interaction.along_pairs(events, plates, steps, minimum_magnitude, **limits))
    windows = cut(interaction.along_windows(events, plates, steps, pairs, bounds["s"], bounds["e"], minimum_magnitude))
    strata = cut(interaction.along_statistics(windows))
    made = (pairs, windows, strata, interaction.annular(strata, interaction.ALONG), interaction.along_coverage(pairs))
    tables = dict(zip(ALONG_TABLES, made, strict=True))
    counts = {n: tables[n].count() for n in ("along_pairs", "along_windows", "along_strata")}
    said = {"minimum_magnitude": minimum_magnitude, "rows": counts}
    metadata = base.metadata | {"bundle_schema_version": BUNDLE_VERSION, "along_boundary": said}
    return commit(spark, folder, base, tables, metadata).metadata
