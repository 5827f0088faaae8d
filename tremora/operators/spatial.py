"""Distance joins on the sphere, centroids, DBSCAN by great-circle distance, and swarms.

Points are put into cubes of a grid around the globe's centre. Two points within a distance lie in the same or in
neighbouring cubes of that size, so a distance join is an equi-join on cubes with an exact residual test; poles and
the date line need no special care.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.functions.geo import EARTH_KM, Vector, bearing, cardinal, haversine_km
from tremora.operators.graph import connected_components
from tremora.operators.lineage import bounded, cut
from tremora.operators.skew import BLOCK, in_blocks, spread
from tremora.operators.validation import require_columns, utc_time


def _cube(lat: Column, lon: Column, size_km: float) -> list[Column]:
    v = Vector.at(lat, lon)
    return [F.floor(x * (EARTH_KM / size_km)).cast("int") for x in (v.x, v.y, v.z)]


CUBE = ("cx", "cy", "cz")


def with_cube(df: DataFrame, size_km: float, spread: Sequence[str] = (), lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """df with cx, cy, cz, its cube; a row for the cube before, the own one and the next along every axis of spread."""
    placed = df.withColumns(dict(zip(CUBE, _cube(F.col(lat), F.col(lon), size_km), strict=True)))
    for c in spread:
        placed = placed.withColumn(c, F.explode(F.array(*(F.col(c) + d for d in (-1, 0, 1)))))
    return placed


#: Rows a spot from which on pairs are sought between spots.
SHARED = 4


def near_pairs(left: DataFrame, right: DataFrame, size_km: float, condition: Column | None = None) -> DataFrame:
    """Rows of left and right (aliases l and r, columns latitude and longitude) within size_km, with distance_km.

    One side is spread along one axis and the other along two, 12 rows for a pair of rows instead of 28, and every two
    rows of neighbouring cubes still meet once. Where many rows share coordinates, distances are taken between spots, and
    rows meet those of near spots only. Pairs are dealt out by their number. Both sides are read several times.
    """
    spots = [df.select("latitude", "longitude").distinct() for df in (left, right)]
    few, many = (sum(df.count() for df in each) for each in (spots, (left, right)))
    if few * SHARED > many:
        return _near(left, right, size_km, condition)
    named = cut(spots[1].withColumn("spot", F.monotonically_increasing_id()))
    near = _near(spots[0], named, size_km, None).select("l.latitude", "l.longitude", "r.spot", "distance_km")
    at = ["latitude", "longitude"]
    one, other = spread(left.join(bounded(cut(near)), at), right.join(bounded(named), at), ["spot"])
    on = (F.col("l.spot") == F.col("r.spot")) & (F.col("l.salt") == F.col("r.salt"))
    return one.alias("l").join(other.alias("r"), on if condition is None else on & condition)


#: Ranges of names that blocks are made of, at most.
RANGES = 1024


def near_names(df: DataFrame, name: str, size_km: float, digits: int | None = None) -> DataFrame:
    """(a, b, distance_km): names a < b, both of column name, of all pairs of rows of df within size_km.

    Where many rows share coordinates, the names of a spot lie in blocks, each from one range of names. Blocks of near
    spots meet where some name of the first lies below some of the second, and names are compared only where not all do;
    distances are taken, and rounded to digits, once for two spots. The last step alone makes pairs of names: nothing as
    long as they is joined, shuffled or stored. df is read several times.
    """
    given = df.select(F.col(name).alias("name"), "latitude", "longitude").where("name is not null")
    spots = given.select("latitude", "longitude").distinct()
    few, many = spots.count(), given.count()
    distance = (F.col("distance_km") if digits is None else F.round("distance_km", digits)).alias("distance_km")
    if few * SHARED > many:
        met = _near(given, given, size_km, F.col("l.name") < F.col("r.name"))
        return met.select(F.col("l.name").alias("a"), F.col("r.name").alias("b"), distance)
    spots = cut(spots.withColumn("spot", F.monotonically_increasing_id()))
    near = cut(_near(spots, spots, size_km, None).select(F.col("l.spot").alias("spot"), F.col("r.spot").alias("other"), distance))
    ranges = min(RANGES, many // max(few * BLOCK, 1) + 1)
    placed = given.join(bounded(spots), ["latitude", "longitude"]).select("spot", "name").repartitionByRange(ranges, "name")
    placed = cut(placed.withColumn("range", F.spark_partition_id()))
    blocks = in_blocks(placed, ["spot", "range"], F.col("name"), F.min("name").alias("first"), F.max("name").alias("last"))
    asked = blocks.join(bounded(near), "spot").select(F.col("other").alias("spot"), "first", "last", "held", "size", "distance_km")
    one, other = spread(asked, blocks, ["spot"], "size")
    on = (F.col("l.spot") == F.col("r.spot")) & (F.col("l.salt") == F.col("r.salt")) & (F.col("l.first") < F.col("r.last"))
    below = (F.col("l.last") < F.col("r.first")).alias("below")
    met = one.alias("l").join(other.alias("r"), on).select(F.explode("l.held").alias("a"), F.col("r.held").alias("held"), "distance_km", below)
    return met.select("a", F.explode("held").alias("b"), "distance_km", "below").where("below or a < b").drop("below")


def _near(left: DataFrame, right: DataFrame, size_km: float, condition: Column | None) -> DataFrame:
    a, b = spread(with_cube(left, size_km, CUBE[:1]), with_cube(right, size_km, CUBE[1:]), list(CUBE))
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*CUBE, "salt")]
    on = same[0] & same[1] & same[2] & same[3]
    joined = a.alias("l").join(b.alias("r"), on if condition is None else on & condition)
    distance = haversine_km(F.col("l.latitude"), F.col("l.longitude"), F.col("r.latitude"), F.col("r.longitude"))
    return joined.withColumn("distance_km", distance).where(F.col("distance_km") <= size_km)


def pairwise(df: DataFrame, id_col: str, most: int = 10_000) -> DataFrame:
    """(i, j, distance_km) of all ordered pairs, zero for i = j: the dense matrix, for few points only.

    More than `most` points are an error; near_pairs and dbscan are for those.
    """
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a dense matrix of more than {most} points; use near_pairs")
    a, b = df.alias("a"), df.alias("b")
    d = haversine_km(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"))
    i, j = F.col(f"a.{id_col}"), F.col(f"b.{id_col}")
    return a.join(b).select(i.alias("i"), j.alias("j"), F.when(i == j, 0.0).otherwise(d).alias("distance_km"))


def centroid(df: DataFrame, *keys: str) -> DataFrame:
    """Centre of gravity on the sphere by key: centroid_latitude, centroid_longitude, event_count.

    Incomplete rows are left out; coordinates whose vectors cancel out fail the job.
    """
    lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    v = Vector.at(lat, lon)
    sums = df.where(lat.isNotNull() & lon.isNotNull()).groupBy(*keys).agg(
        F.sum(v.x).alias("sx"), F.sum(v.y).alias("sy"), F.sum(v.z).alias("sz"), F.count(F.lit(1)).alias("event_count")
    ).where("event_count > 0")
    mean = Vector(F.col("sx"), F.col("sy"), F.col("sz"))
    lost = mean.norm() / F.col("event_count") < 1e-12
    guarded = F.when(lost, F.raise_error(F.lit("coordinates cancel out"))).otherwise(mean.lat())
    return sums.select(*keys, guarded.alias("centroid_latitude"), mean.lon().alias("centroid_longitude"), "event_count")


def in_order(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with the place of each row from 0 in the order of a column without repeats.

    Rows are dealt out by ranges of the column and numbered within their range; only the ranges' sizes, one row for each
    partition, are summed up in one task.
    """
    dealt = cut(df.repartitionByRange(by).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__range", before.alias("__before"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__range").orderBy(by)) - 1
    return dealt.join(F.broadcast(starts), "__range").withColumn(name, place.cast("long")).drop("__range", "__before")


def _cell(lat: Column, lon: Column, side_km: float) -> Column:
    v = Vector.at(lat, lon)
    return F.struct(*(F.floor(x * (EARTH_KM / side_km)).alias(n) for x, n in ((v.x, "x"), (v.y, "y"), (v.z, "z"))))


def _moved(cell: Column, by: Column) -> Column:
    return F.struct(*((cell[c] + by[c]).alias(c) for c in "xyz"))


def _direction(by: Column) -> Column:
    """One of 27 numbers for the signs of a step between cells."""
    x, y, z = (F.signum(by[c].cast("double")).cast("int") + 1 for c in "xyz")
    return 9 * x + 3 * y + z


def _outermost() -> Column:
    """For each of the 27 directions the outermost point (latitude, longitude) of a group."""
    v, point = Vector.at(F.col("latitude"), F.col("longitude")), F.struct("latitude", "longitude")
    steps = (-1, 0, 1)
    return F.array(*(F.max_by(point, a * v.x + b * v.y + c * v.z) for a in steps for b in steps for c in steps))


def _apart(a: str, b: str) -> Column:
    return haversine_km(*(F.col(f"{s}.{c}") for s in (a, b) for c in ("latitude", "longitude")))


def _reaches(point: str, cell: Column, side_km: float, chord_km: float) -> Column:
    """Whether a point lies within a chord of the box of a cell."""
    v = Vector.at(F.col(f"{point}.latitude"), F.col(f"{point}.longitude"))
    gaps = [F.greatest(F.lit(0.0), cell[c] * side_km - x * EARTH_KM, x * EARTH_KM - (cell[c] + 1) * side_km) for c, x in (("x", v.x), ("y", v.y), ("z", v.z))]
    return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2] <= (chord_km * (1 + 1e-6)) ** 2


def dbscan(df: DataFrame, position: str, eps_km: float, min_samples: int) -> DataFrame:
    """(position, cluster_id): density clusters, numbered by their first core point in position order; -1 is noise.

    min_samples counts the point itself; a border point goes to the first cluster it touches. Points of equal
    coordinates are one weighted point.

    Points lie in cells whose diagonal is eps_km, so that the points of a cell are neighbours. A cell of min_samples
    points is all core without a distance; only points of emptier cells are counted around. The core points of a cell
    are one cluster, so what is linked are cells: by the outermost points that face each other, and, between cells that
    this leaves in different clusters, by the points near the other cell. No pair of points is ever written, and a dense
    spot costs as many rows as it has points.
    """
    if eps_km <= 0 or min_samples < 1:
        raise ValueError("eps_km must be positive and min_samples at least 1")
    chord_km = 2 * EARTH_KM * math.sin(min(eps_km / (2 * EARTH_KM), math.pi / 2))
    side_km = chord_km / math.sqrt(3) * (1 - 1e-6)
    points = df.select(
        F.col(position).cast("long").alias("position"),
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
    )
    spots = points.groupBy("latitude", "longitude").agg(F.min("position").alias("id"), F.count(F.lit(1)).alias("n"))
    spots = cut(spots.withColumn("cell", _cell(F.col("latitude"), F.col("longitude"), side_km)))
    cells = cut(spots.groupBy("cell").agg((F.sum("n") >= min_samples).alias("full")))
    steps = [F.struct(*(F.lit(d).alias(c) for d, c in zip(s, "xyz", strict=True))) for s in itertools.product(range(-2, 3), repeat=3)]
    stepped = cells.select("cell", "full", F.explode(F.array(*steps)).alias("by")).withColumn("other", _moved(F.col("cell"), F.col("by")))
    beside = cut(stepped.join(cells.select(F.col("cell").alias("other")), "other", "left_semi"))
    within = _apart("p", "q") <= eps_km
    sparse = spots.join(beside.where("not full").select("cell", "other"), "cell").alias("p")
    around = sparse.join(spots.alias("q"), F.col("p.other") == F.col("q.cell")).where(within)
    counted = around.groupBy("p.id").agg(F.sum("q.n").alias("weight")).where(F.col("weight") >= min_samples).select("id")
    full = spots.join(cells.where("full").select("cell"), "cell", "left_semi")
    cores = cut(full.unionByName(spots.join(counted, "id", "left_semi")).select("id", "latitude", "longitude", "cell"))
    roots = cut(cores.groupBy("cell").agg(F.min("id").alias("root"), _outermost().alias("ends")))
    half = beside.where("(by.x, by.y, by.z) > (0, 0, 0)").select("cell", "other", "by")
    one, two = roots.toDF("cell", "a", "a_ends"), roots.toDF("other", "b", "b_ends")
    facing = half.join(one, "cell").join(two, "other").select(
        "cell", "other", "a", "b", F.get("a_ends", _direction(F.col("by"))).alias("p"), F.get("b_ends", 26 - _direction(F.col("by"))).alias("q")
    )
    met = cut(facing.select("cell", "other", "a", "b", within.alias("near")))
    links = met.where("near").select("a", "b")
    joined = cut(connected_components(links))
    names = [joined.toDF(n, f"{n}_component") for n in ("a", "b")]
    unsure = met.where("not near").join(names[0], "a", "left").join(names[1], "b", "left")
    unsure = cut(unsure.where(F.coalesce("a_component", "a") != F.coalesce("b_component", "b")).select("cell", "other", "a", "b"))
    if not unsure.isEmpty():
        p = unsure.join(cores, "cell").withColumnRenamed("cell", "own").alias("p")
        p = p.where(_reaches("p", F.col("p.other"), side_km, chord_km))
        q = unsure.select(F.col("a").alias("c"), F.col("b").alias("d"), "cell", F.col("other").alias("own")).join(cores.withColumnRenamed("cell", "own"), "own").alias("q")
        q = q.where(_reaches("q", F.col("q.cell"), side_km, chord_km))
        more = p.join(q, (F.col("p.a") == F.col("q.c")) & (F.col("p.b") == F.col("q.d"))).where(within).select("p.a", "p.b").distinct()
        joined = cut(connected_components(links.unionByName(more)))
    labelled = roots.select("cell", "root").join(joined.withColumnRenamed("node", "root"), "root", "left")
    labelled = cut(labelled.select("cell", F.coalesce("component", "root").alias("component")))
    core_labels = cores.join(labelled, "cell").select("id", "component")
    border = sparse.join(cores.select("id"), "id", "left_anti").alias("p").join(cores.join(labelled, "cell").alias("q"), F.col("p.other") == F.col("q.cell"))
    border_labels = border.where(within).groupBy("p.id").agg(F.min("q.component").alias("component"))
    # The smallest id of a component is its first core position.
    numbers = in_order(labelled.select("component").distinct(), "component", "cluster_id")
    labels = core_labels.unionByName(border_labels).join(numbers, "component").select("id", "cluster_id")
    by_spot = spots.join(labels, "id", "left").select("latitude", "longitude", F.coalesce("cluster_id", F.lit(-1).cast("long")).alias("cluster_id"))
    return points.join(by_spot, ["latitude", "longitude"]).select("position", "cluster_id")


def cluster_statistics(labelled: DataFrame) -> DataFrame:
    """For each cluster of labelled(position, latitude, longitude, cluster_id): size, centre, radius and mean distance
    to the centre."""
    members = labelled.where("cluster_id >= 0")
    centres = centroid(members, "cluster_id")
    distance = haversine_km(F.col("latitude"), F.col("longitude"), F.col("centroid_latitude"), F.col("centroid_longitude"))
    spread = members.join(centres.drop("event_count"), "cluster_id").withColumn("d", distance)
    return spread.groupBy("cluster_id", "centroid_latitude", "centroid_longitude").agg(
        F.count(F.lit(1)).alias("event_count"), F.max("d").alias("radius_km"), F.avg("d").alias("mean_distance_km")
    )


def cluster_members(labelled: DataFrame) -> DataFrame:
    """(cluster_id, position) of all members: a row each, however large a cluster is."""
    return labelled.where("cluster_id >= 0").select("cluster_id", "position")


def swarm_ids(members: DataFrame) -> DataFrame:
    """(cluster_id, swarm_id): a digest of the members' positions as text, in order of that text.

    The members of a cluster pass through one task in order, which holds a running digest and never the list.
    """

    def digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for part in parts:
            ids, texts = part["cluster_id"].to_numpy(), part["text"].to_numpy()
            ends = np.append(np.nonzero(ids[1:] != ids[:-1])[0] + 1, len(ids))
            done, start = [], 0
            for end in ends[ends > 0]:
                lead = "\x1f"
                if at is None or ids[start] != at:
                    if at is not None:
                        done.append((at, f"swarm-{state.hexdigest()[:12]}"))
                    at, state, lead = ids[start], hashlib.sha256(), ""
                state.update((lead + "\x1f".join(texts[start:end])).encode())
                start = end
            yield pd.DataFrame(done, columns=["cluster_id", "swarm_id"])
        if at is not None:
            yield pd.DataFrame([(at, f"swarm-{state.hexdigest()[:12]}")], columns=["cluster_id", "swarm_id"])

    dealt = members.select("cluster_id", F.col("position").cast("string").alias("text")).repartition("cluster_id")
    return dealt.sortWithinPartitions("cluster_id", "text").mapInPandas(digests, "cluster_id long, swarm_id string")


@dataclass(frozen=True)
class SwarmConfig:
    eps_km: float = 10.0
    min_samples: int = 3
    minimum_events: int = 3
    active_days: float = 1.0
    recent_days: float = 7.0
    tolerance: float = 0.0
    stationary_km: float = 1.0

    def __post_init__(self) -> None:
        if self.active_days > self.recent_days:
            raise ValueError("active_days must not exceed recent_days")


def swarm_events(df: DataFrame) -> DataFrame:
    """(position, time, latitude, longitude, depth, magnitude) of complete rows; values out of range fail the job."""
    columns = ["time", "latitude", "longitude", "depth", "magnitude"]
    require_columns(df, ["position", *columns])
    typed = df.select("position", utc_time(F.col("time")).alias("time"), *(F.col(c).cast("double").alias(c) for c in columns[1:]))
    whole = typed.dropna(subset=columns)
    good = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & (F.col("depth") >= 0)
    return whole.withColumn("depth", F.when(~good, F.raise_error(F.lit("value out of range"))).otherwise(F.col("depth")))


def _trend(slope: Column, tolerance: float) -> Column:
    return F.when(slope.isNull(), "insufficient_data").when(slope > tolerance, "increasing").when(
        slope < -tolerance, "decreasing"
    ).otherwise("stable")


def swarms(df: DataFrame, config: SwarmConfig = SwarmConfig(), reference: datetime | None = None) -> DataFrame:
    """One row for each swarm: span, rate, density, centre, trends of magnitude and depth, migration and activity."""
    events = cut(swarm_events(df))
    labelled = cut(events.join(dbscan(events, "position", config.eps_km, config.min_samples), "position"))
    stats = cluster_statistics(labelled).where(F.col("event_count") >= config.minimum_events)
    now = F.lit(reference).cast("timestamp") if reference else F.max("time")
    clock = events.agg(now.alias("reference"), F.max("time").alias("latest"))
    clock = clock.select(F.when(F.col("reference") < F.col("latest"), F.raise_error(F.lit("reference time before the latest event"))).otherwise(F.col("reference")).alias("reference"))
    inside = labelled.where("cluster_id >= 0")
    by_time = Window.partitionBy("cluster_id").orderBy("time", "position")
    whole = Window.partitionBy("cluster_id")
    days = (F.unix_micros("time") - F.unix_micros(F.min("time").over(whole))) / 86_400e6
    sequence = inside.withColumns(
        {"days": days, "early": F.row_number().over(by_time) <= F.floor(F.count(F.lit(1)).over(whole) / 2)}
    )
    moved = F.count_distinct("days") > 1
    basics = sequence.crossJoin(F.broadcast(clock)).groupBy("cluster_id").agg(
        F.min("time").alias("start_time"),
        F.max("time").alias("end_time"),
        F.max("days").alias("duration_days"),
        F.avg("magnitude").alias("mean_magnitude"),
        F.avg("depth").alias("mean_depth_km"),
        F.when(moved, F.regr_slope("magnitude", "days")).alias("magnitude_slope"),
        F.when(moved, F.regr_slope("depth", "days")).alias("depth_slope"),
        F.count_if(F.unix_micros("time") >= F.unix_micros("reference") - F.lit(config.recent_days * 86_400e6)).alias("recent_event_count"),
        ((F.unix_micros(F.max("reference")) - F.unix_micros(F.max("time"))) / 86_400e6).alias("age_days"),
    )
    halves = centroid(sequence, "cluster_id", "early").select("cluster_id", "early", "centroid_latitude", "centroid_longitude")
    early = halves.where("early").select("cluster_id", F.col("centroid_latitude").alias("lat1"), F.col("centroid_longitude").alias("lon1"))
    late = halves.where("not early").select("cluster_id", F.col("centroid_latitude").alias("lat2"), F.col("centroid_longitude").alias("lon2"))
    ends = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    shift_km, turn = haversine_km(*ends), bearing(*ends)
    area = F.pi() * F.col("radius_km") * F.col("radius_km")
    rate_days = F.when(F.col("duration_days") > 0, F.col("duration_days")).otherwise(1.0)
    return (
        stats.join(basics, "cluster_id")
        .join(swarm_ids(cluster_members(labelled)), "cluster_id")
        .join(early, "cluster_id", "left")
        .join(late, "cluster_id", "left")
        .withColumns(
            {
                "event_rate_per_day": F.col("event_count") / rate_days,
                "spatial_density_events_per_sq_km": F.when(area > 0, F.col("event_count") / area),
                "magnitude_trend": _trend(F.col("magnitude_slope"), config.tolerance),
                "depth_trend": _trend(F.col("depth_slope"), config.tolerance),
                "migration_km": F.coalesce(shift_km, F.lit(0.0)),
            }
        )
        .withColumn("migration_bearing", F.when(F.col("migration_km") > config.stationary_km, turn))
        .withColumn(
            "migration_direction",
            F.when(F.col("migration_bearing").isNull(), "stationary").otherwise(cardinal(F.col("migration_bearing"))),
        )
        .withColumn(
            "activity_status",
            F.when(F.col("event_count") < 2, "insufficient_data")
            .when(F.col("age_days") <= config.active_days, "active")
            .when(F.col("age_days") <= config.recent_days, "recently_active")
            .otherwise("inactive"),
        )
        .drop("lat1", "lon1", "lat2", "lon2", "age_days")
        .orderBy(F.desc("end_time"), F.desc("event_count"), "cluster_id")
    )
