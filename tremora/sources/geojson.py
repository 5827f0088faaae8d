"""GeoJSON feeds: events in three strictnesses, fault traces, and boundary steps in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.functions.seismic import number
from tremora.operators.validation import query_filter, with_ordinal
from tremora.operators import revisions
from tremora.sources.schemas import CATALOG_COLUMNS, GEOJSON


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(feature) for each feature of the collections under path, one document a file."""
    docs = spark.read.schema(GEOJSON).option("multiLine", True).json(path)
    return docs.select(F.explode("features").alias("feature"))


def feature_type() -> str:
    """The type of one feature, for features that come as text."""
    return GEOJSON.split("features array<", 1)[1].removesuffix(">")


def _millis(value: Column) -> Column:
    """Epoch milliseconds as number or text, or ISO text; null if neither."""
    ms = number(value)
    return F.when(ms.isNotNull(), F.timestamp_micros((ms * 1000).cast("bigint"))).otherwise(value.try_cast("timestamp"))


def _text(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def _fields() -> dict[str, Column]:
    p, c = F.col("feature.properties"), F.col("feature.geometry.coordinates")
    return {
        "event_id": F.coalesce(_text(F.col("feature.id")), _text(p["code"])),
        "time": _millis(p["time"]),
        "latitude": F.get(c, F.lit(1)),
        "longitude": F.get(c, F.lit(0)),
        "depth": F.get(c, F.lit(2)),
        "magnitude": number(p["mag"]),
        "magnitude_type": _text(p["magType"]),
        "place": _text(p["place"]),
        "status": _text(p["status"]),
        "event_type": _text(p["type"]),
        "source": F.coalesce(_text(p["net"]), F.lit("USGS")),
        "updated_at": _millis(p["updated"]),
    }


def _classified(features: DataFrame) -> DataFrame:
    """Fields with state: incomplete without what every event needs, invalid where something is out of range."""
    made = features.select(F.col("feature.properties").alias("__p"), *(c.alias(n) for n, c in _fields().items()))
    time_given, mag_given = F.col("__p")["time"].isNotNull(), F.col("__p")["mag"].isNotNull()
    missing = F.col("event_id").isNull() | ~time_given | ~mag_given
    missing = missing | F.col("latitude").isNull() | F.col("longitude").isNull() | F.col("depth").isNull()
    wrong = F.col("time").isNull() | F.col("magnitude").isNull() | (F.col("depth") < 0)
    wrong = wrong | ~F.col("latitude").between(-90, 90) | ~F.col("longitude").between(-180, 180)
    state = F.when(missing, "incomplete").when(wrong, "invalid").otherwise("valid")
    return made.withColumn("state", state).drop("__p")


def ingest(features: DataFrame, start, end, box=None, minimum_magnitude: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, counts): valid features of the query, newest revision each, and one row of what was left out."""
    classified = _classified(features)
    valid = query_filter(classified.where("state = 'valid'").select(*CATALOG_COLUMNS), start, end, box, minimum_magnitude)
    kept = revisions.winners(valid)
    states = classified.agg(
        F.count(F.lit(1)).alias("downloaded"),
        F.count_if(F.col("state") == "incomplete").alias("incomplete"),
        F.count_if(F.col("state") == "invalid").alias("invalid"),
    )
    sizes = valid.agg(F.count(F.lit(1)).alias("selected")).crossJoin(kept.agg(F.count(F.lit(1)).alias("final_count")))
    counts = states.crossJoin(sizes).withColumn("duplicates", F.col("selected") - F.col("final_count"))
    return kept, counts


def parse_strict(features: DataFrame) -> DataFrame:
    """Catalog events; the job fails at a feature without id, time or coordinates. A magnitude may be missing and a
    depth negative."""
    made = features.select(*(c.alias(n) for n, c in _fields().items()))
    needed = F.col("event_id").isNotNull() & F.col("time").isNotNull() & F.col("latitude").isNotNull()
    needed = needed & F.col("longitude").isNotNull() & F.col("depth").isNotNull()
    return made.withColumn("event_id", F.when(~needed, F.raise_error(F.lit("feature is missing required values"))).otherwise(F.col("event_id")))


def parse_lenient(features: DataFrame) -> DataFrame:
    """Provider rows; malformed features are skipped, a missing depth is null, the newest update of an id stays."""
    p = F.col("feature.properties")
    fields = _fields()
    made = with_ordinal(features).select(
        fields["event_id"].alias("event_id"),
        F.lower(fields["source"]).alias("source"),
        fields["time"].alias("event_time_utc"),
        fields["updated_at"].alias("updated_time_utc"),
        fields["latitude"].alias("latitude"),
        fields["longitude"].alias("longitude"),
        fields["depth"].alias("depth_km"),
        fields["magnitude"].alias("magnitude"),
        fields["magnitude_type"].alias("magnitude_type"),
        fields["place"].alias("place"),
        fields["event_type"].alias("event_type"),
        fields["status"].alias("status"),
        F.when(p["tsunami"].isin("0", "false"), False).when(p["tsunami"].isNotNull(), True).alias("tsunami_flag"),
        number(p["felt"]).cast("long").alias("felt_reports"),
        number(p["sig"]).cast("long").alias("significance"),
        _text(p["alert"]).alias("alert_level"),
        _text(p["detail"]).alias("detail_url"),
        _text(p["url"]).alias("source_url"),
        F.col("__ordinal"),
    )
    good = made.where("event_id is not null and event_time_utc is not null and latitude is not null and longitude is not null")
    keyed = good.withColumns({"time": F.col("event_time_utc"), "updated_at": F.col("updated_time_utc")})
    return revisions.first_newest(keyed, "__ordinal").drop("time", "updated_at", "__ordinal")


FAULTS = (
    "features array<struct<id:string, geometry:struct<type:string, coordinates:string>, properties:map<string,string>>>"
)


def _property(names: tuple[str, ...]) -> Column:
    """The first of the named properties that isn't empty, whatever the case of its name."""
    lowered = F.transform_keys(F.coalesce(F.col("f.properties"), F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    return F.coalesce(*(_text(F.try_element_at(lowered, F.lit(n.lower()))) for n in names))


def read_faults(spark: SparkSession, path: str, id_names=("catalog_id", "id", "fault_id"), name_names=("name", "fault_name")) -> DataFrame:
    """(fault_id, name, coordinates array<struct<lat, lon>>) of the lines in feature collections; each part of a
    multi-line is a trace of its own, id:part-k. Other geometries are skipped."""
    docs = spark.read.schema(FAULTS).option("multiLine", True).json(path)
    return _traces(docs.select(F.posexplode("features").alias("n", "f")), id_names, name_names)


def parse_faults(features: DataFrame, id_names=("catalog_id", "id", "fault_id"), name_names=("name", "fault_name")) -> DataFrame:
    """The same of features(feature), GeoJSON text, numbered as they come."""
    one = FAULTS.removeprefix("features array<").removesuffix(">")
    return _traces(features.select(F.monotonically_increasing_id().alias("n"), F.from_json("feature", one).alias("f")), id_names, name_names)


def _traces(f: DataFrame, id_names: tuple[str, ...], name_names: tuple[str, ...]) -> DataFrame:
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    line = F.when(kind == "LineString", F.array(F.from_json(raw, "array<array<double>>")))
    lines = F.when(kind == "MultiLineString", F.from_json(raw, "array<array<array<double>>>")).otherwise(line)
    base = F.coalesce(_text(F.col("f.id")), _property(id_names), F.format_string("fault-%06d", F.col("n") + 1))
    parts = f.select(base.alias("id"), _property(name_names).alias("name"), kind.alias("kind"), F.posexplode(lines).alias("k", "points"))
    part_id = F.when(F.col("kind") == "MultiLineString", F.concat("id", F.lit(":part-"), (F.col("k") + 1).cast("string"))).otherwise(F.col("id"))
    points = F.transform("points", lambda q: F.struct(F.get(q, F.lit(1)).alias("lat"), F.get(q, F.lit(0)).alias("lon")))
    return parts.select(part_id.alias("fault_id"), "name", points.alias("coordinates")).orderBy("fault_id")


def _step_geometry() -> Column:
    """A line, or two lines cut at the date line, in longitude and latitude."""
    lon1, lat1, lon2, lat2 = (F.col(c) for c in ("start_longitude", "start_latitude", "end_longitude", "end_latitude"))
    edge = F.when(lon1 > 0, 180.0).otherwise(-180.0)
    other = F.when(lon2 < lon1, lon2 + 360).otherwise(lon2 - 360)
    middle = lat1 + (lat2 - lat1) * (edge - lon1) / (other - lon1)
    line = F.to_json(F.named_struct(F.lit("type"), F.lit("LineString"), F.lit("coordinates"), F.array(F.array(lon1, lat1), F.array(lon2, lat2))))
    two = F.array(F.array(F.array(lon1, lat1), F.array(edge, middle)), F.array(F.array(-edge, middle), F.array(lon2, lat2)))
    cut = F.to_json(F.named_struct(F.lit("type"), F.lit("MultiLineString"), F.lit("coordinates"), two))
    return F.when(F.abs(lon2 - lon1) > 180, cut).otherwise(line)


def step_features(steps: DataFrame) -> DataFrame:
    """(step_id, feature): each step as GeoJSON text."""
    properties = F.to_json(F.struct(*(c for c in steps.columns if not c.endswith(("_latitude", "_longitude")))))
    text = F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), _step_geometry(), F.lit("}"))
    return steps.select("step_id", text.alias("feature"))
