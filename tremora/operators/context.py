"""Nearest mapped feature of each event: faults and plate-boundary steps through a grid of envelopes.

Features are taken apart into great-circle segments. Each feature is filed under the grid cells that its envelope,
widened by the search radius, touches; an event meets the features of its own cell only, and the exact distance
decides. Everything is an equi-join and a minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.functions.geo import segment_km
from tremora.operators.lineage import bounded, cut, fits
from tremora.operators.skew import dealt

LATITUDE_KM, EQUATOR_KM = 110.574, 111.320
#: Segments that every event may be held against without the index.
FEW_SEGMENTS = 1000
CELL = 2.0
#: The inner ring's share of the radius, and the smallest cell in degrees that it is searched with.
RINGS, LEAST_CELL = 8, 0.05


def segments(traces: DataFrame, id_col: str = "fault_id") -> DataFrame:
    """(id, segment, lat1, lon1, lat2, lon2) of traces(id, coordinates array<struct<lat, lon>>); a lone point is a
    segment of no length."""
    pairs = F.when(
        F.size("coordinates") > 1,
        F.transform(
            F.slice("coordinates", 1, F.greatest(F.size("coordinates") - 1, F.lit(1))),
            lambda p, i: F.struct(p.alias("a"), F.get("coordinates", i + 1).alias("b")),
        ),
    ).otherwise(F.transform("coordinates", lambda p: F.struct(p.alias("a"), p.alias("b"))))
    return traces.select(id_col, F.posexplode(pairs).alias("segment", "s")).select(
        id_col,
        "segment",
        F.col("s.a.lat").alias("lat1"),
        F.col("s.a.lon").alias("lon1"),
        F.col("s.b.lat").alias("lat2"),
        F.col("s.b.lon").alias("lon2"),
    )


def _cell(value: Column, low: float, size: float, count: int) -> Column:
    return F.least(F.greatest(F.floor((value - low) / size), F.lit(0)), F.lit(count - 1)).cast("int")


def grid_cells(segs: DataFrame, id_col: str, radius_km: float, cell: float = CELL) -> DataFrame:
    """(id, lat_cell, lon_cell): the cells in which an event within radius_km of a feature can lie.

    Envelopes that span over 180 degrees (they cross the date line) or reach a pole take all longitudes.
    """
    rows, columns = -(-180 // cell), -(-360 // cell)
    box = segs.groupBy(id_col).agg(
        F.least(F.min("lat1"), F.min("lat2")).alias("south"),
        F.greatest(F.max("lat1"), F.max("lat2")).alias("north"),
        F.least(F.min("lon1"), F.min("lon2")).alias("west"),
        F.greatest(F.max("lon1"), F.max("lon2")).alias("east"),
    )
    south = F.greatest(F.lit(-90.0), F.col("south") - radius_km / LATITUDE_KM)
    north = F.least(F.lit(90.0), F.col("north") + radius_km / LATITUDE_KM)
    shrink = F.cos(F.radians(F.greatest(F.abs(south), F.abs(north))))
    reach = F.when(shrink > 1e-6, radius_km / (EQUATOR_KM * shrink)).otherwise(360.0)
    low, high = F.col("west") - reach, F.col("east") + reach
    everywhere = (F.col("east") - F.col("west") > 180) | (high - low >= 360)
    first, last = F.floor((low + 180) / cell).cast("int"), F.floor((high + 180) / cell).cast("int")
    around = F.array_distinct(F.transform(F.sequence(first, last), lambda k: F.pmod(k, F.lit(int(columns)))))
    lon_cells = F.when(everywhere, F.sequence(F.lit(0), F.lit(int(columns) - 1))).otherwise(around)
    lat_cells = F.sequence(_cell(south, -90, cell, int(rows)), _cell(north, -90, cell, int(rows)))
    return box.select(id_col, F.explode(lat_cells).alias("lat_cell"), lon_cells.alias("lon_cells")).select(
        id_col, "lat_cell", F.explode("lon_cells").alias("lon_cell")
    )


def _found(spots: DataFrame, filed: DataFrame, id_col: str, radius_km: float, cell: float, small: bool) -> DataFrame:
    """(latitude, longitude, best): the nearest filed feature within the radius of each spot that has one."""
    rows, columns = int(-(-180 // cell)), int(-(-360 // cell))
    placed = spots.withColumns(
        {"lat_cell": _cell(F.col("latitude"), -90, cell, rows), "lon_cell": _cell(F.col("longitude"), -180, cell, columns)}
    )
    keys = ["lat_cell", "lon_cell"]
    if small:
        met = placed.join(F.broadcast(filed), keys)
    else:
        one, every = dealt(placed, filed, keys)
        met = one.join(every, [*keys, "salt"])
    return _best(met, id_col, radius_km)


def _best(met: DataFrame, id_col: str, radius_km: float) -> DataFrame:
    distance = segment_km(*(F.col(c) for c in ("latitude", "longitude", "lat1", "lon1", "lat2", "lon2")))
    found = met.withColumn("distance_km", distance).where(F.col("distance_km") <= radius_km)
    return found.groupBy("latitude", "longitude").agg(F.min(F.struct("distance_km", id_col)).alias("best"))


def nearest(
    events: DataFrame, segs: DataFrame, id_col: str, radius_km: float, indexed: bool = True, cell: float = CELL
) -> DataFrame:
    """(event_id, id, distance_km): the nearest feature within radius_km of each event that has one; the smaller id
    wins between equals. Without the index every event meets every segment, which is for few segments only.

    Events of equal coordinates are one spot. Filed segments that fit a broadcast meet all spots where those lie. More
    segments are searched in two rings: what lies within an eighth of the radius is found among the few segments filed
    that near, and only spots without such a feature meet those of the whole radius, crowded cells in several tasks.
    """
    points = events.select("event_id", "latitude", "longitude")
    spots = cut(points.select("latitude", "longitude").distinct())
    if indexed:
        filed = cut(grid_cells(segs, id_col, radius_km, cell).join(segs, id_col))
        if fits(filed):
            best = _found(spots, filed, id_col, radius_km, cell, True)
        else:
            inner, small = radius_km / RINGS, max(LEAST_CELL, cell / RINGS)
            near = cut(_found(spots, grid_cells(segs, id_col, inner, small).join(segs, id_col), id_col, inner, small, False))
            left = spots.join(near, ["latitude", "longitude"], "left_anti")
            best = near.unionByName(_found(left, filed, id_col, radius_km, cell, False))
    else:
        if segs.limit(FEW_SEGMENTS + 1).count() > FEW_SEGMENTS:
            raise ValueError(f"more than {FEW_SEGMENTS} segments need the index")
        best = _best(spots.join(F.broadcast(segs)), id_col, radius_km)
    joined = points.join(bounded(cut(best)), ["latitude", "longitude"])
    return joined.select("event_id", F.col(f"best.{id_col}").alias(id_col), F.col("best.distance_km").alias("distance_km"))


def step_segments(steps: DataFrame) -> DataFrame:
    """Plate-boundary steps as segments of their own."""
    return steps.select(
        "step_id",
        F.lit(0).alias("segment"),
        F.col("start_latitude").alias("lat1"),
        F.col("start_longitude").alias("lon1"),
        F.col("end_latitude").alias("lat2"),
        F.col("end_longitude").alias("lon2"),
    )


CONTEXT = ("step_id", "boundary_id", "left_plate", "right_plate", "boundary_class")


def nearest_boundary(events: DataFrame, steps: DataFrame, radius_km: float = 500.0) -> DataFrame:
    """The association of each event with the nearest step, with what is known of the step."""
    return nearest(events, step_segments(steps), "step_id", radius_km).join(steps.select(*CONTEXT), "step_id")


def plate_pair(left: Column, right: Column) -> Column:
    """The same for both orientations; null without either."""
    return F.when(left.isNotNull() & right.isNotNull(), F.concat_ws("|", F.array_sort(F.array(left, right))))
