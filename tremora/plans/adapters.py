"""The driver's tables seen as seismic catalogs, in SQL that Spark and DuckDB share but for the name of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = """
select cast(event_id as {text}) as event_id, ts as event_time_utc,
  case when event_type = 'signup' then null else least(value / 50, cast('9.5' as double)) end as magnitude,
  case when event_type = 'view' then null else cast(event_id % 700 as double) end as depth_km,
  17 + (user_id % 30) / 10 as latitude, -69 + (event_id % 55) / 10 as longitude,
  case when event_type = 'click' then 'mww' else 'mb' end as magnitude_type,
  concat('place ', cast(user_id % 100 as {text})) as place
from {events}
"""
ORDERS = """
select cast(o_orderkey as {text}) as event_id, o_orderdate as time, o_totalprice / 60000 as magnitude,
  cast(o_orderkey % 700 as double) as depth
from {orders}
"""
#: All events, by the names that the studies use, with magnitudes that reach the usual study limits.
LOCATED = """
select event_id, event_time_utc as time, case when magnitude > cast('7.1' as double) then cast('9.5' as double) else magnitude + cast('2.4' as double) end as magnitude, magnitude_type,
  latitude, longitude + cast('0.033' as double) as longitude, coalesce(depth_km, cast(0 as double)) as depth
from ({events_catalog}) c
"""
#: The least magnitude of the pair studies, a parameter of their operators.
STUDY_MAGNITUDE = 6.0
STEPS = """
select concat('step-', cast(10000 + n_nationkey as {text})) as step_id,
  concat('B', cast(n_nationkey % 5 as {text})) as boundary_id,
  'P0' as left_plate, concat('P', cast(1 + n_nationkey % 5 % 2 as {text})) as right_plate,
  case when n_nationkey % 2 = 0 then 'SUB' else 'OTF' end as boundary_class,
  17 + cast(n_nationkey % 5 as double) * 3 / 4 as start_latitude, -69 + cast(floor(n_nationkey / 5) as double) as start_longitude,
  17 + cast(n_nationkey % 5 as double) * 3 / 4 as end_latitude, -68 + cast(floor(n_nationkey / 5) as double) as end_longitude,
  100 + cast(n_nationkey as double) as length_km
from {nation}
"""


def _sql(query: str, **tables: str) -> str:
    return query.format(text="string", **tables)


def _read(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Table name as a file query, so that no view is left behind."""
    return f"parquet.`{sf_dir}/{name}.parquet`"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.sql(_sql(EVENTS, events=_read(spark, sf_dir, "events")))
    return made.withColumn("event_time_utc", F.col("event_time_utc").cast("timestamp"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events with time, magnitude and depth over several years."""
    made = spark.sql(_sql(ORDERS, orders=_read(spark, sf_dir, "orders")))
    return made.withColumn("time", F.col("time").cast("timestamp"))


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = _sql(EVENTS, events=_read(spark, sf_dir, "events"))
    return spark.sql(LOCATED.format(events_catalog=inner)).withColumn("time", F.col("time").cast("timestamp"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_sql(STEPS, nation=_read(spark, sf_dir, "nation")))


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of three points from the steps: start, middle a little north, end."""
    lat, lon = F.col("start_latitude"), F.col("start_longitude")
    points = [
        F.struct(lat.alias("lat"), lon.alias("lon")),
        F.struct((lat + 0.25).alias("lat"), (lon + 0.5).alias("lon")),
        F.struct(F.col("end_latitude").alias("lat"), F.col("end_longitude").alias("lon")),
    ]
    return steps(spark, sf_dir).select(F.concat(F.lit("fault-"), F.substring("step_id", 6, 9)).alias("fault_id"), F.array(*points).alias("coordinates"))


#: The same as common table expressions for DuckDB.
DUCK_CATALOG = EVENTS.format(text="varchar", events="events")
DUCK = {
    "catalog": DUCK_CATALOG,
    "observed": ORDERS.format(text="varchar", orders="orders"),
    "located": LOCATED.format(events_catalog=DUCK_CATALOG),
    "strong": f"select * from ({LOCATED.format(events_catalog=DUCK_CATALOG)}) l where magnitude >= {STUDY_MAGNITUDE}",
    "steps": STEPS.format(text="varchar", nation="nation"),
}


def duck(query: str, *names: str, **more: str) -> str:
    """query with the named adapters, and further queries, before it."""
    parts = [f"{n} as ({DUCK[n]})" for n in names] + [f"{n} as ({q})" for n, q in more.items()]
    return f"with recursive {', '.join(parts)} {query}" if parts else query
