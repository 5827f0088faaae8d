"""Queries through what the library writes and reads: stores, streams, feeds, files and bundles.

Each derives its input from the driver's tables, writes it to the shared checkpoint folder, and returns what a reader of
the library gets back, with the SQL of what that must be.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.operators import context, interaction, revisions
from tremora.operators.lineage import cut, ensure_checkpoint_dir
from tremora.plans import bundle, dashboard
from tremora.plans.adapters import duck, faults, located, steps
from tremora.sources import boundaries, catalogs, geojson, verified
from tremora.sources.schemas import CATALOG_COLUMNS
from tremora.streaming import catalog_stream

Query = Callable[[SparkSession, str], DataFrame]

REGION = "caribbean"
START, END = datetime(2024, 1, 5), datetime(2024, 1, 25)
BOX = (17.5, 19.5, -68.5, -64.0)
LEAST = 3.0
#: Events of one document of a feed.
FEED = 1000
FORMATS = ("csv", "json", "orc", "parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4().hex}"


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    """The located events in the columns of a stored catalog."""
    more = {"place": F.concat(F.lit("near "), "event_id"), "status": F.lit("reviewed"), "event_type": F.lit("earthquake"), "source": F.lit("us"), "updated_at": F.col("time")}
    return located(spark, d).withColumns(more).select(*CATALOG_COLUMNS)


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Four of five events as they were first, and later revisions of every third together with the fifth ones."""
    base, key = _catalog(spark, d), F.col("event_id").cast("long")
    revised = {
        "magnitude": F.when(key % 2 == 0, F.col("magnitude") + 1).otherwise(F.col("magnitude")),
        "updated_at": F.when(key % 2 == 0, F.col("updated_at") + F.expr("interval 1 hour")).otherwise(F.col("updated_at")),
    }
    return base.where(key % 5 != 0), base.where((key % 3 == 0) | (key % 5 == 0)).withColumns(revised)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), F.round("magnitude", 4).alias("magnitude"))


def store_range(spark: SparkSession, d: str) -> DataFrame:
    """A region is saved, revised by an upsert, and read between two times."""
    store, (old, new) = catalogs.CatalogStore(spark, _folder(spark, "store")), _halves(spark, d)
    store.save(REGION, old)
    store.upsert(REGION, new)
    return _shown(store.load(REGION, START, END))


def store_update_counts(spark: SparkSession, d: str) -> DataFrame:
    """What an update with a box, a time range and a least magnitude says it did."""
    store, (old, new) = catalogs.CatalogStore(spark, _folder(spark, "store")), _halves(spark, d)
    store.save(REGION, old)
    return store.update(REGION, new, START, END, BOX, LEAST)


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The same revisions as files that a stream takes in one after the other."""
    folder, store = _folder(spark, "arrivals"), catalogs.CatalogStore(spark, _folder(spark, "store"))
    at = _folder(spark, "progress")
    for part in _halves(spark, d):
        part.write.mode("append").parquet(folder)
        catalog_stream.upsert_stream(catalog_stream.read_stream(spark, folder), store, REGION, at).awaitTermination()
    return _shown(store.load(REGION))


def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Days that the watermark has closed, by a stream over a folder that holds every event twice."""
    folder, out = _folder(spark, "arrivals"), _folder(spark, "days")
    for _ in range(2):
        _catalog(spark, d).write.mode("append").parquet(folder)
    counts = catalog_stream.daily_counts(catalog_stream.read_stream(spark, folder))
    query = counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark, "progress"))
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    read = spark.read.schema("date date, event_count long, maximum_magnitude double").parquet(out)
    return read.select("date", "event_count", F.round("maximum_magnitude", 4).alias("maximum_magnitude"))


def _feed(spark: SparkSession, d: str) -> str:
    """The events as GeoJSON documents of about FEED features."""
    key = F.floor(F.col("event_id").cast("long") / FEED)
    said = {"mag": F.col("magnitude").cast("string"), "time": F.unix_millis("time").cast("string"), "magType": F.col("magnitude_type"), "type": F.col("event_type"), "net": F.col("source")}
    properties = F.create_map(*(x for n, c in said.items() for x in (F.lit(n), c)))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude", "depth").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("event_id").alias("id"), geometry.alias("geometry"), properties.alias("properties"))
    documents = _catalog(spark, d).groupBy(key.alias("k")).agg(F.collect_list(feature).alias("features"))
    text = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features"))
    folder = _folder(spark, "feed")
    documents.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return folder


def feed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of a GeoJSON feed within a box, a time range and a least magnitude."""
    events, _ = geojson.ingest(geojson.read_features(spark, _feed(spark, d)), START, END, BOX, LEAST)
    return _shown(events)


def feed_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many features of the same feed were incomplete, invalid or double, and how many stay."""
    _, counts = geojson.ingest(geojson.read_features(spark, _feed(spark, d)), START, END, BOX, LEAST)
    return counts.select("incomplete", "invalid", "duplicates", "final_count")


def first_of_equal_updates(spark: SparkSession, d: str) -> DataFrame:
    """Of events by kind of magnitude and place number, the newest day's, and of those the first in input order."""
    keyed = located(spark, d).select(
        F.col("magnitude_type").alias("source"), (F.col("event_id").cast("long") % 300).cast("string").alias("event_id"), "time",
        F.date_trunc("day", "time").alias("updated_at"), "magnitude", F.col("event_id").cast("long").alias("came"),
    )
    return revisions.first_newest(keyed, "came").select("source", "event_id", F.col("came").alias("ordinal"), F.round("magnitude", 4).alias("magnitude"))


def catalog_formats(spark: SparkSession, d: str) -> DataFrame:
    """The catalog written and read again in every format."""
    folder, found = _folder(spark, "catalogs"), []
    for kind in FORMATS:
        path = f"{folder}/events.{kind}"
        catalogs.write_catalog(_catalog(spark, d), path)
        read = catalogs.read_catalog(spark, path)
        found.append(
            read.agg(
                F.lit(kind).alias("format"),
                F.count(F.lit(1)).alias("n"),
                F.round(F.sum(F.col("magnitude").cast("double")), 4).alias("magnitudes"),
                F.date_format(F.min("time"), "yyyy-MM-dd HH:mm:ss").alias("first"),
                F.date_format(F.max("updated_at"), "yyyy-MM-dd HH:mm:ss").alias("last"),
            )
        )
    return reduce(DataFrame.unionByName, found)


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    """The CSV export, read as any reader would."""
    path = f"{_folder(spark, 'export')}/events.csv"
    catalogs.export_csv(_catalog(spark, d), path)
    read = spark.read.option("header", True).csv(path)
    return read.select("event_id", F.round(F.col("magnitude").cast("double"), 4).alias("magnitude"), F.round(F.col("longitude").cast("double"), 4).alias("longitude"), "source")


def bundle_versions(spark: SparkSession, d: str) -> DataFrame:
    """Tables of the newest version of a bundle, after one of its three tables was replaced."""
    folder, events, lines = _folder(spark, "bundle"), located(spark, d), steps(spark, d)
    first = bundle.commit(spark, folder, None, {"events": events, "steps": lines, "strong": interaction.eligible(events)}, {"bundle_schema_version": 4})
    bundle.commit(spark, folder, first, {"strong": interaction.eligible(events, 8.0)}, {"bundle_schema_version": bundle.BUNDLE_VERSION})
    opened = bundle.open_bundle(spark, folder, ("events", "steps", "strong"), bundle.BUNDLE_VERSION)
    return reduce(DataFrame.unionByName, (df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n")) for n, df in opened.items()))


def dashboard_overview(spark: SparkSession, d: str) -> DataFrame:
    """Counts, years and coverage over all events."""
    events = located(spark, d)
    near = cut(context.nearest_boundary(events, steps(spark, d), 25.0))
    beside = context.nearest(events, context.segments(faults(spark, d)), "fault_id", 40.0)
    return dashboard.overview(dashboard.denormalised(events, near, beside))


def fault_traces(spark: SparkSession, d: str) -> DataFrame:
    """Traces out of a GeoJSON collection of multi-lines, one of each fault's two parts a row."""
    points = F.transform("coordinates", lambda p: F.array(p["lon"], p["lat"]))
    parts = F.array(F.slice(points, 1, 2), F.slice(points, 2, 2))
    geometry = F.struct(F.lit("MultiLineString").alias("type"), parts.alias("coordinates"))
    properties = F.create_map(F.lit("Name"), F.concat(F.lit("fault "), "fault_id"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("fault_id").alias("id"), geometry.alias("geometry"), properties.alias("properties"))
    documents = faults(spark, d).groupBy(F.substring("fault_id", 1, 10).alias("k")).agg(F.collect_list(feature).alias("features"))
    folder = _folder(spark, "traces")
    documents.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    read, first = geojson.read_faults(spark, folder), F.get("coordinates", F.lit(0))
    return read.select("fault_id", "name", F.size("coordinates").alias("points"), F.round(first["lat"], 4).alias("latitude"), F.round(first["lon"], 4).alias("longitude"))


def boundary_lines(spark: SparkSession, d: str) -> DataFrame:
    """Boundary steps written as fifteen columns of text and parsed."""
    number = F.col("step_id").substr(6, 5).cast("int") - 9999
    fields = [
        F.concat(number.cast("string"), F.lit(":")), F.concat("left_plate", F.lit("-"), "right_plate"), "start_longitude", "start_latitude", "end_longitude", "end_latitude", "length_km",
        F.lit("90"), F.lit("12.5"), F.lit("80"), F.lit("1"), F.lit("2"), F.lit("-3000"), F.when(number % 2 == 0, "200").otherwise("55"), F.concat("boundary_class", F.when(number % 3 == 0, "*").otherwise("")),
    ]
    lines = steps(spark, d).select(F.concat_ws(" ", *((F.col(f) if isinstance(f, str) else f).cast("string") for f in fields)).alias("value"))
    folder = _folder(spark, "lines")
    lines.write.text(folder)
    columns = ("step_id", "left_plate", "polarity", "right_plate", "boundary_class", "in_orogen", "age", "velocity", "length_km")
    return boundaries.read_steps(spark, folder).select(*columns, F.round("start_longitude", 4).alias("start_longitude"), F.round("end_latitude", 4).alias("end_latitude"))


def step_geometries(spark: SparkSession, d: str) -> DataFrame:
    """Boundary steps as GeoJSON text, taken apart again."""
    text, kinds = F.col("feature"), "struct<geometry:struct<type:string,coordinates:array<array<double>>>,properties:map<string,string>>"
    made = geojson.step_features(steps(spark, d)).select("step_id", F.from_json(text, kinds).alias("f"))
    points, first = F.col("f.geometry.coordinates"), lambda k, c: F.round(F.get(F.get(F.col("f.geometry.coordinates"), F.lit(k)), F.lit(c)), 4)
    return made.select(
        "step_id", F.col("f.geometry.type").alias("kind"), F.size(points).alias("points"), first(0, 0).alias("longitude"), first(1, 1).alias("latitude"),
        F.col("f.properties")["boundary_id"].alias("boundary_id"),
    )


def blob_checksums(spark: SparkSession, d: str) -> DataFrame:
    """The git blob checksum of every document's text."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", verified.blob_sha1_column(F.coalesce("text", F.lit("")).cast("binary")).alias("sha1"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        store_range, store_update_counts, stream_upsert, stream_daily_counts, feed_events, feed_counts, first_of_equal_updates, catalog_formats,
        export_rows, bundle_versions, dashboard_overview, fault_traces, boundary_lines, step_geometries, blob_checksums,
    )
}

_KEY = "cast(event_id as bigint)"
_REVISED = f"select *, case when {_KEY} % 2 = 0 then magnitude + 1 else magnitude end as later from located where {_KEY} % 3 = 0 or {_KEY} % 5 = 0"
_NEWEST = f"select l.event_id, l.time, case when {_KEY.replace('event_id', 'l.event_id')} % 2 = 0 and r.event_id is not null then l.magnitude + 1 else l.magnitude end as magnitude from located l left join revised r using (event_id)"
_SHOWN = "event_id, strftime(time, '%Y-%m-%d %H:%M:%S') as time, round(magnitude, 4) as magnitude"
_RANGE = f"time >= timestamp '{START}' and time < timestamp '{END}'"
_INSIDE = f"{_RANGE} and latitude between {BOX[0]} and {BOX[1]} and longitude between {BOX[2]} and {BOX[3]}"

ORACLES: dict[str, str] = {
    "store_range": duck(f"select {_SHOWN} from newest where {_RANGE}", "located", revised=_REVISED, newest=_NEWEST),
    "store_update_counts": duck(
        f"""select ins as inserted, upd as updated, base - upd as unchanged, base + ins as final_count, came as downloaded from
  (select count(*) filter ({_KEY} % 5 = 0 and chosen) as ins, count(*) filter ({_KEY} % 5 <> 0 and {_KEY} % 2 = 0 and chosen) as upd, count(*) as came
    from (select *, {_INSIDE} and later >= {LEAST} as chosen from revised)), (select count(*) as base from located where {_KEY} % 5 <> 0)""",
        "located",
        revised=_REVISED,
    ),
    "stream_upsert": duck(f"select {_SHOWN} from newest", "located", revised=_REVISED, newest=_NEWEST),
    "stream_daily_counts": duck(
        """select cast(time as date) as date, count(*) as event_count, round(max(magnitude), 4) as maximum_magnitude from located
where cast(time as date) + interval 1 day <= (select max(time) - interval 7 days from located) group by 1""",
        "located",
    ),
    "feed_events": duck(f"select {_SHOWN} from located where {_INSIDE} and magnitude >= {LEAST}", "located"),
    "feed_counts": duck(
        f"""select count(*) filter (magnitude is null) as incomplete, cast(0 as bigint) as invalid, cast(0 as bigint) as duplicates,
  count(*) filter ({_INSIDE} and magnitude >= {LEAST}) as final_count from located""",
        "located",
    ),
    "first_of_equal_updates": duck(
        f"""select source, event_id, came as ordinal, round(magnitude, 4) as magnitude from (select magnitude_type as source, cast({_KEY} % 300 as varchar) as event_id, {_KEY} as came, magnitude,
  row_number() over (partition by magnitude_type, {_KEY} % 300 order by cast(time as date) desc, {_KEY}) as k from located) where k = 1""",
        "located",
    ),
    "catalog_formats": duck(
        """select format, n, magnitudes, first, last from (select unnest(['csv', 'json', 'orc', 'parquet']) as format),
  (select count(*) as n, round(sum(magnitude), 4) as magnitudes, strftime(min(time), '%Y-%m-%d %H:%M:%S') as first, strftime(max(time), '%Y-%m-%d %H:%M:%S') as last from located)""",
        "located",
    ),
    "export_rows": duck("select event_id, round(magnitude, 4) as magnitude, round(longitude, 4) as longitude, 'us' as source from located", "located"),
    "bundle_versions": duck(
        """select 'events' as table_name, count(*) as n from located union all select 'steps', count(*) from steps
union all select 'strong', count(*) from located where magnitude >= 8""",
        "located",
        "steps",
    ),
    "fault_traces": duck(
        """select 'fault-' || substring(step_id, 6, 9) || ':part-' || k as fault_id, 'fault fault-' || substring(step_id, 6, 9) as name, cast(2 as integer) as points,
  round(start_latitude + 0.25 * (k - 1), 4) as latitude, round(start_longitude + 0.5 * (k - 1), 4) as longitude from steps, (select unnest([1, 2]) as k)""",
        "steps",
    ),
    "boundary_lines": duck(
        """select printf('pb2002-step-%04d', k) as step_id, left_plate, '-' as polarity, right_plate, boundary_class, k % 3 = 0 as in_orogen,
  case when k % 2 = 0 then null else cast(55 as double) end as age, cast(12.5 as double) as velocity, length_km, round(start_longitude, 4) as start_longitude, round(end_latitude, 4) as end_latitude
from (select *, cast(substring(step_id, 6, 5) as integer) - 9999 as k from steps)""",
        "steps",
    ),
    "step_geometries": duck(
        "select step_id, 'LineString' as kind, cast(2 as integer) as points, round(start_longitude, 4) as longitude, round(end_latitude, 4) as latitude, boundary_id from steps",
        "steps",
    ),
    "blob_checksums": "select doc_id, sha1('blob ' || cast(strlen(coalesce(text, '')) as varchar) || chr(0) || coalesce(text, '')) as sha1 from documents",
}
