"""Retrospective pair studies: events near each other in space and time, matched windows, and the same along the
plate-boundary network.

Pairs come from one equi-join on time buckets and on cubes of the sphere with exact residual tests, so neither a time
range nor a radius turns into a nested loop. Either side is spread over some of the axes only, and crowded cubes are dealt
to several tasks. Windows count each pair in the smallest time and distance window that hold it; the counts of larger
windows are running sums over those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremora.functions.geo import EARTH_KM, haversine_km
from tremora.functions.seismic import seismic_moment
from tremora.operators.context import plate_pair
from tremora.operators.lineage import bounded, cut, fits
from tremora.operators.network import project, routes, step_distances
from tremora.operators.skew import TASKS, in_blocks, spread
from tremora.operators.spatial import CUBE, with_cube
from tremora.operators.validation import fail_on_duplicates

DAYS = (1.0, 7.0, 30.0, 90.0, 365.0)
KILOMETRES = (100.0, 250.0, 500.0, 1000.0, 2000.0)
THRESHOLDS = (7.0, 7.5, 8.0)
DAY = 86_400e6
AVAILABLE, MISSING, DIFFERENT, DISCONNECTED = (
    "available", "missing_projection", "different_plate_pair", "disconnected_same_plate_pair_network",
)


def eligible(events: DataFrame, minimum_magnitude: float = 6.0) -> DataFrame:
    """Events of at least this magnitude; those without one fail it."""
    return events.where(F.col("magnitude") >= minimum_magnitude)


def _seconds(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp")) / DAY


def _span(days: float) -> int:
    """The longest lag within so many days, in microseconds."""
    near = int(days * DAY)
    return max(k for k in range(near - 2, near + 3) if k / DAY <= days)


def close_pairs(events: DataFrame, max_days: float, max_km: float) -> DataFrame:
    """Ordered pairs (aliases l earlier, r later) with 0 < lag_days <= max_days and distance_km <= max_km.

    The earlier event is spread over two time buckets and one axis of space, the later one over the other two axes: 15
    rows for an event of both sides. Pairs are dealt out by their number. Events are read several times.
    """
    window_limits((max_days, max_km))
    size, span = min(max_km, 2 * EARTH_KM), _span(max_days)
    timed = events.withColumn("us", F.unix_micros(F.col("time").cast("timestamp")))
    bucket = F.floor(F.col("us") / max(span, 1))
    early = with_cube(timed, size, CUBE[:1]).withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))
    late = with_cube(timed, size, CUBE[1:]).withColumn("bucket", bucket)
    early, late = spread(early, late, [*CUBE, "bucket"])
    keys = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*CUBE, "bucket", "salt")]
    lag = F.col("r.us") - F.col("l.us")
    on = keys[0] & keys[1] & keys[2] & keys[3] & keys[4] & (lag > 0) & (lag <= span)
    # No distance is shorter than its part along a meridian, which costs no sine.
    on &= F.abs(F.col("l.latitude") - F.col("r.latitude")) <= math.degrees(max_km / EARTH_KM) * (1 + 1e-9) + 1e-9
    joined = early.alias("l").join(late.alias("r"), on)
    distance = haversine_km(F.col("l.latitude"), F.col("l.longitude"), F.col("r.latitude"), F.col("r.longitude"))
    return joined.withColumns({"lag_days": lag / DAY, "distance_km": distance}).where(F.col("distance_km") <= max_km)


#: Events a place from which on counts are taken between places.
SHARED = 4
#: Moments that an array of a place holds at most, by aim.
MOMENTS = 4096


def places(events: DataFrame, fields: Sequence[str], max_days: float) -> tuple[DataFrame, DataFrame, bool]:
    """events with us and place; the places; and whether they are so few that counts are taken between them.

    A place is what events of equal coordinates and fields share within a slab of time of max_days. Two events within
    max_days lie in the same or in neighbouring slabs. A column place of the events gives way to it.
    """
    timed = events.drop("place").withColumn("us", F.unix_micros(F.col("time").cast("timestamp")))
    timed = timed.withColumn("slab", F.floor(F.col("us") / max(_span(max_days), 1)))
    keys = ("latitude", "longitude", *fields, "slab")
    named = cut(timed.select(*keys).distinct().withColumn("place", F.monotonically_increasing_id()))
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"e.{k}").eqNullSafe(F.col(f"p.{k}"))
    placed = timed.alias("e").join(bounded(named).alias("p"), same).select("e.*", "p.place")
    return placed, named, named.count() * SHARED <= timed.count()


def close_places(named: DataFrame, max_km: float, slabs: Sequence[int], held: str | None = None) -> DataFrame:
    """Places (aliases l, r) within max_km whose slabs differ by one of slabs, with distance_km; l.own is l's slab.

    Column held says how many events a row stands for, where their pairs are to be dealt out.
    """
    size = min(max_km, 2 * EARTH_KM)
    left = with_cube(named, size, CUBE[:1]).withColumn("own", F.col("slab"))
    left = left.withColumn("slab", F.explode(F.array(*(F.col("own") + k for k in slabs))))
    left, right = spread(left, with_cube(named, size, CUBE[1:]), [*CUBE, "slab"], held)
    keys = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*CUBE, "slab", "salt")]
    joined = left.alias("l").join(right.alias("r"), keys[0] & keys[1] & keys[2] & keys[3] & keys[4])
    distance = haversine_km(F.col("l.latitude"), F.col("l.longitude"), F.col("r.latitude"), F.col("r.longitude"))
    return joined.withColumn("distance_km", distance).where(F.col("distance_km") <= max_km)


def _moment_arrays(placed: DataFrame) -> DataFrame:
    """(place, part, us, n): the moments of a place in sorted arrays of about MOMENTS, and how many events each has."""
    moments = placed.where("us is not null").groupBy("place", "us").agg(F.count(F.lit(1)).alias("n"))
    sizes = moments.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / MOMENTS).alias("parts"))
    dealt_out = moments.join(sizes, "place").withColumn("part", F.pmod(F.xxhash64("us"), F.col("parts")))
    held = F.array_sort(F.collect_list(F.struct("us", "n")))
    arrays = dealt_out.groupBy("place", "part").agg(held.alias("m"))
    return cut(arrays.select("place", "part", F.col("m.us").alias("us"), F.col("m.n").alias("n")))


#: Moments of sources that one task takes, by aim.
SOURCES = 16_384


def _cells_of_places(placed: DataFrame, met: DataFrame, kinds: Sequence[str], days: Sequence[float]) -> DataFrame:
    """(place, us, time_window_days, kinds, pre, post) from met(place, other, kinds): how many events of the other places
    of each kind lie before and after an event at that place and time, by the smallest time window that holds them.
    A place's counts may come in several rows, to be summed.

    Moments lie in sorted arrays. Those of a place's others follow each other in a batch of rows, are put in one order of
    time and searched for the window edges of the place's own moments. Neither a pair of events nor a moment of another
    place is a row, and only met is shuffled where the arrays fit a broadcast.
    """
    limits = window_limits(days)
    spans = [0, *(_span(d) for d in limits)]
    edges = np.array([*spans, *(-s - 1 for s in spans)], dtype="int64")
    run, half = ["place", "part", *kinds], len(spans)
    arrays = _moment_arrays(placed)
    right = arrays.select(F.col("place").alias("other"), F.col("us").alias("later"), F.col("n").alias("later_n"))
    context = placed.sparkSession.sparkContext
    held = arrays.agg(F.coalesce(F.sum(F.size("us")), F.lit(0))).first()[0]
    tasks = min(TASKS, max(4 * context.defaultParallelism, -(-held // SOURCES)))

    def in_runs(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "place", "part").sortWithinPartitions(*run)

    asked = met.join(bounded(arrays.select("place", "part")), "place").select(*run, "other")
    small = fits(arrays)
    if small:
        # Stored in order: broadcast joins keep it.
        asked, arrays, right = cut(in_runs(asked)), F.broadcast(arrays), F.broadcast(right)
    both = asked.join(arrays, ["place", "part"]).join(right, "other").select(*run, "us", "later", "later_n")
    both = both if small else in_runs(both)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            changed = np.zeros(batch.num_rows, dtype=bool)
            changed[0] = True
            for c in run:
                codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                changed[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(changed)
            ends = [*starts[1:], batch.num_rows]
            (us, us_at), (later, later_at), (n, n_at) = (
                (x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()) for x in map(batch.column, ("us", "later", "later_n"))
            )
            rows, times, windows, pres, posts = [], [], [], [], []
            for first, last in zip(starts, ends, strict=True):
                moments, weights = later[later_at[first] : later_at[last]], n[n_at[first] : n_at[last]]
                order = np.argsort(moments, kind="stable")
                upto, at = np.concatenate(([0], np.cumsum(weights[order]))), us[us_at[first] : us_at[first + 1]]
                sums = upto[np.searchsorted(moments[order], at[None, :] + edges[:, None], "right")]
                post, pre = np.diff(sums[:half], axis=0), -np.diff(sums[half:], axis=0)
                window, k = np.nonzero(pre + post)
                rows.append(np.full(len(k), first))
                times.append(at[k])
                windows.append(window)
                pres.append(pre[window, k])
                posts.append(post[window, k])
            at = pa.array(np.concatenate(rows))
            made = {"place": batch.column("place").take(at), "us": np.concatenate(times)}
            made |= {"time_window_days": np.array(limits)[np.concatenate(windows)]}
            made |= {c: batch.column(c).take(at) for c in kinds}
            made |= {"pre": np.concatenate(pres), "post": np.concatenate(posts)}
            yield pa.RecordBatch.from_pydict({c: x if isinstance(x, pa.Array) else pa.array(x) for c, x in made.items()})

    types = dict(met.dtypes)
    schema = ", ".join(["place long, us long, time_window_days double", *(f"`{c}` {types[c]}" for c in kinds), "pre long, post long"])
    return both.mapInArrow(counted, schema)


def pairs_of_places(placed: DataFrame, met: DataFrame, max_days: float) -> DataFrame:
    """met(place, other, ...) with pairs: how many later events of other lie within max_days of an event of place.

    Moments lie in sorted arrays; each two arrays are counted by searches in one batch of rows.
    """
    span = _span(max_days)
    arrays = _moment_arrays(placed).drop("part")
    right = arrays.toDF("other", "later", "later_n")

    @F.pandas_udf("long")
    def within(us: pd.Series, n: pd.Series, later: pd.Series, later_n: pd.Series) -> pd.Series:
        made = []
        for a, k, b, m in zip(us, n, later, later_n, strict=True):
            upto = np.concatenate(([0], np.cumsum(m)))
            first, last = np.searchsorted(b, a, "right"), np.searchsorted(b, a + span, "right")
            made.append(int(np.dot(k, upto[last] - upto[first])))
        return pd.Series(made, dtype="int64")

    # Few bytes but much work: as many tasks as there are cores, and some more.
    met = met.repartition(4 * placed.sparkSession.sparkContext.defaultParallelism)
    joined = met.join(bounded(arrays), "place").join(bounded(right), "other")
    return joined.withColumn("pairs", within("us", "n", "later", "later_n")).drop("us", "n", "later", "later_n").where("pairs > 0")


def with_context(events: DataFrame, associations: DataFrame) -> DataFrame:
    """Events with their boundary's fields, null where they have none; a doubled association fails the job."""
    fields = ("boundary_id", "left_plate", "right_plate", "boundary_class")
    return events.join(fail_on_duplicates(associations, "event_id").select("event_id", *fields), "event_id", "left")


def pairs(
    events: DataFrame,
    associations: DataFrame,
    minimum_magnitude: float = 6.0,
    max_lag_days: float = 365.0,
    max_distance_km: float = 2000.0,
    shown_as: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Every later event near an earlier one, with both ends' context. same_* is null where an end lacks context.

    What hangs on one event is made once an event, not once a pair; so are the columns of shown_as, made of the columns of
    an event and shown in place of its time, magnitude and so on.
    """
    fields = ("event_id", "time", "magnitude", "magnitude_type", "boundary_id", "left_plate", "right_plate", "boundary_class")
    catalog = with_context(eligible(events, minimum_magnitude), associations)
    made = {f"shown_{c}": (shown_as or {}).get(c, F.col(c)) for c in fields}
    made |= {"moment_nm": seismic_moment(F.col("magnitude"), F.col("magnitude_type")), "plates": plate_pair(F.col("left_plate"), F.col("right_plate"))}
    catalog = cut(catalog.select("time", "latitude", "longitude", *(c.alias(n) for n, c in made.items())))
    met, shown = close_pairs(catalog, max_lag_days, max_distance_km), []
    for side, name in (("l", "source"), ("r", "target")):
        shown += [F.col(f"{side}.shown_{c}").alias(f"{name}_{c}") for c in fields]
        shown.append(F.col(f"{side}.moment_nm").alias(f"{name}_moment_nm"))
    return met.select(
        *shown,
        "lag_days",
        "distance_km",
        (F.col("l.plates") == F.col("r.plates")).alias("same_plate_pair"),
        (F.col("l.shown_boundary_id") == F.col("r.shown_boundary_id")).alias("same_boundary_id"),
        (F.col("l.shown_boundary_class") == F.col("r.shown_boundary_class")).alias("same_boundary_class"),
    )


def window_limits(limits: Sequence[float]) -> list[float]:
    """Distinct window lengths in order; an error unless there are some, all positive and finite."""
    made = sorted({float(x) for x in limits})
    if not made or not all(0 < x < float("inf") for x in made):
        raise ValueError("windows must be positive and finite numbers")
    return made


def _grid(events: DataFrame, days: Sequence[float], kilometres: Sequence[float]) -> DataFrame:
    """events with a row for each time and distance window."""
    return events.withColumn("time_window_days", F.explode(F.array(*(F.lit(d) for d in window_limits(days))))).withColumn(
        "distance_window_km", F.explode(F.array(*(F.lit(k) for k in window_limits(kilometres))))
    )


def _smallest(value: Column, limits: Sequence[float]) -> Column:
    """The smallest of the limits that holds a value; null beyond all of them."""
    chain = None
    for limit in window_limits(limits):
        chain = (F if chain is None else chain).when(value <= limit, F.lit(limit))
    return chain


def _summed(counts: DataFrame, sources: DataFrame, days: Sequence[float], kilometres: Sequence[float]) -> DataFrame:
    """counts(source_event_id, smallest time and distance window, numbers) summed up over the windows within each window
    of sources(source_event_id), zeros included. All sums of a source share one shuffle, of one row for each window."""
    keys = ["source_event_id", "time_window_days", "distance_window_km"]
    full = _grid(sources.select("source_event_id"), days, kilometres).join(counts, keys, "left")
    for along, across in (keys[1:], keys[:0:-1]):
        order = Window.partitionBy("source_event_id", across).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        full = full.withColumns({c: F.sum(F.coalesce(c, F.lit(0).cast("long"))).over(order) for c in counts.columns if c not in keys})
    return full


def _edges(profile_start: datetime, profile_end: datetime) -> dict[str, Column]:
    if profile_start >= profile_end:
        raise ValueError("profile_start must be earlier than profile_end")
    day, span = _seconds(F.col("source_time")), F.col("time_window_days")
    pre = day - span >= _seconds(F.lit(profile_start))
    post = day + span <= _seconds(F.lit(profile_end))
    return {"full_pre_window": pre, "full_post_window": post, "edge_eligible": pre & post}


def windows(
    events: DataFrame,
    associations: DataFrame,
    profile_start: datetime,
    profile_end: datetime,
    minimum_magnitude: float = 6.0,
    days: Sequence[float] = DAYS,
    kilometres: Sequence[float] = KILOMETRES,
) -> DataFrame:
    """Counts of events before and after each source within each time and distance window, zeros included."""
    catalog = cut(with_context(eligible(events, minimum_magnitude), associations))
    placed, named, shared = places(catalog, ("boundary_id", "left_plate", "right_plate"), max(days))
    met = close_places(named, max(kilometres), (-1, 0, 1)) if shared else close_pairs(catalog, max(days), max(kilometres))
    pair = [plate_pair(F.col(f"{s}.left_plate"), F.col(f"{s}.right_plate")) for s in ("l", "r")]
    kept = {
        "distance_window_km": _smallest(F.col("distance_km"), kilometres),
        "same_pair": F.coalesce(pair[0] == pair[1], F.lit(False)),
        "same_boundary": F.coalesce(F.col("l.boundary_id") == F.col("r.boundary_id"), F.lit(False)),
    }
    shown = [c.alias(n) for n, c in kept.items()]
    if shared:
        cells = _cells_of_places(placed, met.select(F.col("l.place").alias("place"), F.col("r.place").alias("other"), *shown), tuple(kept), days)
    else:
        # A pair lies after its earlier and before its later event: two rows.
        ends = F.array(
            F.struct(F.col("l.event_id").alias("source_event_id"), F.lit(True).alias("post")),
            F.struct(F.col("r.event_id").alias("source_event_id"), F.lit(False).alias("post")),
        )
        seen = met.select(F.explode(ends).alias("e"), _smallest(F.col("lag_days"), days).alias("time_window_days"), *shown)
        cells = seen.select("e.*", "time_window_days", *kept).groupBy("source_event_id", "time_window_days", *kept).agg(
            F.count_if(~F.col("post")).alias("pre"), F.count_if("post").alias("post")
        )
    kinds = {"all": F.lit(True), "same_plate_pair": F.col("same_pair"), "same_boundary": F.col("same_boundary")}
    key = ["place", "us"] if shared else ["source_event_id"]
    counts = cells.groupBy(*key, "time_window_days", "distance_window_km").agg(
        *(
            F.coalesce(F.sum(F.when(cond, F.col(side))), F.lit(0)).alias(f"{side}_count_{kind}")
            for kind, cond in kinds.items()
            for side in ("pre", "post")
        )
    )
    if shared:
        counts = placed.select(F.col("event_id").alias("source_event_id"), *key).join(counts, key).drop(*key)
    context = ("boundary_id", "left_plate", "right_plate", "boundary_class")
    sources = catalog.select(
        F.col("event_id").alias("source_event_id"),
        F.col("time").alias("source_time"),
        F.col("magnitude").alias("source_magnitude"),
        F.col("magnitude_type").alias("source_magnitude_type"),
        seismic_moment(F.col("magnitude"), F.col("magnitude_type")).alias("source_moment_nm"),
        *(F.col(c).alias(f"source_{c}") for c in context),
    )
    return (
        _summed(counts, sources, days, kilometres)
        .join(sources, "source_event_id")
        .withColumns(_edges(profile_start, profile_end))
        .withColumn("source_has_plate_context", F.col("source_boundary_id").isNotNull())
    )


def _totals(kind: str, use: Column) -> list[Column]:
    pre, post = F.col(f"pre_count_{kind}"), F.col(f"post_count_{kind}")
    change, zero = post - pre, F.lit(0).cast("long")
    return [
        F.coalesce(F.sum(F.when(use, pre)), zero).alias(f"pre_{kind}_count"),
        F.coalesce(F.sum(F.when(use, post)), zero).alias(f"post_{kind}_count"),
        F.avg(F.when(use, change)).alias(f"mean_post_minus_pre_{kind}"),
        F.count_if(use & (change > 0)).alias(f"source_post_gt_pre_{kind}_count"),
        F.count_if(use & (change == 0)).alias(f"source_post_eq_pre_{kind}_count"),
        F.count_if(use & (change < 0)).alias(f"source_post_lt_pre_{kind}_count"),
    ]


def _with_medians(totals: DataFrame, observations: DataFrame, keys: Sequence[str], uses: dict[str, Column]) -> DataFrame:
    """totals by keys with the exact median of post minus pre of each kind.

    Differences are whole numbers, so how often each occurs is counted first, before the shuffle; the middle one is then
    where the running count passes half. No group's values are held.
    """
    changes = (F.struct(F.lit(k).alias("kind"), F.when(use, F.col(f"post_count_{k}") - F.col(f"pre_count_{k}")).alias("change")) for k, use in uses.items())
    each = observations.select(*keys, F.explode(F.array(*changes)).alias("m")).select(*keys, "m.kind", "m.change")
    counted = each.where("change is not null").groupBy(*keys, "kind", "change").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*keys, "kind")
    running = F.sum("n").over(group.orderBy("change").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumns({"upto": running, "total": F.sum("n").over(group)})

    def middle(kind: str, at: Column) -> Column:
        return F.min(F.when((F.col("kind") == kind) & (F.col("upto") > F.floor(at / 2)), F.col("change")))

    medians = placed.groupBy(*keys).agg(
        *(((middle(k, F.col("total") - 1) + middle(k, F.col("total"))) / 2).alias(f"median_post_minus_pre_{k}") for k in uses)
    )
    return totals.join(medians, list(keys), "left")


def _derived(kinds: Sequence[str]) -> dict[str, Column]:
    made = {}
    for k in kinds:
        pre, post = F.col(f"pre_{k}_count"), F.col(f"post_{k}_count")
        made |= {f"post_minus_pre_{k}": post - pre, f"post_pre_{k}_ratio": F.when(pre != 0, post / pre)}
    return made


RADIAL = ("all", "same_plate_pair", "same_boundary")


def cumulative(observations: DataFrame, *keys: str) -> DataFrame:
    """Totals over edge-eligible sources by window, those of same_* over sources with plate context."""
    edge = F.col("edge_eligible")
    placed = edge & F.col("source_has_plate_context")
    uses, by = {k: edge if k == "all" else placed for k in RADIAL}, (*keys, "time_window_days", "distance_window_km")
    made = observations.groupBy(*by).agg(
        F.count_if(edge).alias("eligible_source_count"),
        F.count_if(placed).alias("plate_context_source_count"),
        *(c for k, use in uses.items() for c in _totals(k, use)),
    )
    return _with_medians(made, observations, by, uses).withColumns(_derived(RADIAL))


def by_threshold(observations: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """observations once for every source magnitude that they reach; strata overlap."""
    return observations.withColumn(
        "source_minimum_magnitude", F.explode(F.array(*(F.lit(float(t)) for t in sorted(set(thresholds)))))
    ).where("source_magnitude >= source_minimum_magnitude")


def stratified(observations: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    return cumulative(by_threshold(observations, thresholds), "source_minimum_magnitude")


def annular(statistics: DataFrame, kinds: Sequence[str] = RADIAL) -> DataFrame:
    """Rings between successive distances from cumulative statistics by threshold and time window."""
    order = Window.partitionBy("source_minimum_magnitude", "time_window_days").orderBy("distance_window_km")
    rings = {f"{s}_{k}_count": F.col(f"{s}_{k}_count") - F.lag(f"{s}_{k}_count", 1, 0).over(order) for k in kinds for s in ("pre", "post")}
    lower = F.lag("distance_window_km", 1, 0.0).over(order)
    counts = [c for c in ("eligible_source_count", "plate_context_source_count") if c in statistics.columns]
    return statistics.select(
        "source_minimum_magnitude",
        "time_window_days",
        lower.alias("lower_distance_km"),
        F.col("distance_window_km").alias("upper_distance_km"),
        *counts,
        *(c.alias(n) for n, c in rings.items()),
    ).withColumns(_derived(kinds))


ALONG = ("along_boundary", "routed_radial")


def along_pairs(
    events: DataFrame,
    associations: DataFrame,
    steps: DataFrame,
    minimum_magnitude: float = 6.0,
    max_lag_days: float = 365.0,
    max_along_km: float = 2000.0,
    max_offset_km: float = 500.0,
    shown_as: Mapping[str, Column] | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Pairs within a radial envelope of the route limit plus both offsets, with their route and its status.

    The events of a place lie in blocks. What hangs on places is made once for two blocks: the radius, the route by a table
    of the distances between steps, and both rounded to digits where these are given. The last step alone makes pairs of
    events, of which only the lag is their own: they are neither stored, joined nor shuffled. shown_as is as in pairs, for
    event_id, time and magnitude.
    """
    window_limits((max_lag_days, max_along_km))
    envelope, span = max_along_km + 2 * max_offset_km, _span(max_lag_days)
    own, ends = ("event_id", "time", "magnitude"), (("l", "earlier"), ("r", "later"))
    made = ((shown_as or {}).get(c, F.col(c)).alias(f"shown_{c}") for c in own)
    catalog = _on_steps(events, associations, steps, minimum_magnitude).select("time", "latitude", "longitude", *ON_STEP, *made)
    placed, named, _ = places(catalog, ON_STEP, max_lag_days)
    timed = placed.where("us is not null").select("place", "us", *(F.col(f"shown_{c}").alias(c) for c in own))
    blocks = cut(named.join(in_blocks(timed, ["place"], F.struct("us", *own)), "place"))
    shared = [F.col(f"{side}.{c}").alias(f"{name}_{c}") for side, name in ends for c in ON_STEP[:5]]
    flat = close_places(blocks, envelope, (0, 1), "size").select(
        *(F.col(f"{side}.held").alias(name) for side, name in ends), *shared, F.col("distance_km").alias("radial_distance_km"), *_ends_on_steps()
    )
    met = _with_routes(flat, named, steps, envelope, max_along_km)
    if digits is not None:
        met = met.withColumns({c: F.round(c, digits) for c in ("radial_distance_km", "along_boundary_distance_km")})
    for _, name in ends:
        met = met.select("*", F.inline(name).alias(f"{name}_us", *(f"{name}_{c}" for c in own))).drop(name)
    lag = F.col("later_us") - F.col("earlier_us")
    shown = [f"{name}_{c}" for _, name in ends for c in (*own, *ON_STEP[:5])]
    return met.where((lag > 0) & (lag <= span)).select(*shown, _days(lag, max_lag_days, digits).alias("lag_days"), "radial_distance_km", *ROUTE)


ROUTE = ("route_status", "same_plate_pair", "same_boundary_id", "along_boundary_distance_km", "within_along_boundary_limit")
#: Days up to which lags are told apart from halves by their nearest double.
EXACT = 10_000


def _days(us: Column, most: float, digits: int | None) -> Column:
    """Microseconds, above zero and up to so many days, in days; rounded half up to digits as F.round does, but by whole
    numbers where these tell the same, as that takes no decimal a row."""
    if digits is None:
        return us / DAY
    unit, rest = divmod(int(DAY), 10**digits)
    return F.round(us / DAY, digits) if rest or most > EXACT else F.floor((2 * us + unit) / (2 * unit)) / float(10**digits)


def _on_steps(events: DataFrame, associations: DataFrame, steps: DataFrame, minimum_magnitude: float) -> DataFrame:
    """Eligible events with the step they project on and their distances along it, null where they have none."""
    catalog = eligible(events, minimum_magnitude)
    projected = project(catalog, fail_on_duplicates(associations, "event_id"), steps).select("event_id", *ON_STEP)
    return cut(catalog.join(projected, "event_id", "left"))


ON_STEP = ("step_id", "boundary_id", "left_plate", "right_plate", "boundary_class", "distance_from_start_km", "distance_to_end_km")


def _ends_on_steps() -> list[Column]:
    names = {"step_id": "step_id", "distance_from_start_km": "from_start", "distance_to_end_km": "to_end"}
    return [F.col(f"{side}.{c}").alias(f"{x}_{n}") for side, x in (("l", "s"), ("r", "t")) for c, n in names.items()]


def _with_routes(flat: DataFrame, catalog: DataFrame, steps: DataFrame, envelope: float, max_along_km: float) -> DataFrame:
    """flat pairs of catalog's events, or of their places, with the status and length of their route."""
    size = min(envelope, 2 * EARTH_KM)
    used = catalog.where("step_id is not null").select("step_id", "latitude", "longitude").distinct()
    a, b = (with_cube(used, size, axes).select("step_id", *CUBE).distinct() for axes in (CUBE[:1], CUBE[1:]))
    beside = a.withColumnRenamed("step_id", "s_step_id").join(b.withColumnRenamed("step_id", "t_step_id"), list(CUBE))
    distances = step_distances(beside.select("s_step_id", "t_step_id"), steps)
    same = plate_pair(F.col("earlier_left_plate"), F.col("earlier_right_plate")) == plate_pair(
        F.col("later_left_plate"), F.col("later_right_plate")
    )
    missing = F.col("s_step_id").isNull() | F.col("t_step_id").isNull()
    status = F.when(missing, MISSING).when(~same, DIFFERENT).when(F.col("along_km").isNull(), DISCONNECTED).otherwise(AVAILABLE)
    along = F.when(F.col("route_status") == AVAILABLE, F.col("along_km"))
    return (
        routes(flat, distances)
        .withColumn("route_status", status)
        .withColumns(
            {
                "same_plate_pair": F.when(~missing, same),
                "same_boundary_id": F.col("earlier_boundary_id") == F.col("later_boundary_id"),
                "along_boundary_distance_km": along,
                "within_along_boundary_limit": F.coalesce(along <= max_along_km, F.lit(False)),
            }
        )
        .drop("s_step_id", "s_from_start", "s_to_end", "t_step_id", "t_from_start", "t_to_end", "along_km")
    )


def routed_places(
    events: DataFrame,
    associations: DataFrame,
    steps: DataFrame,
    minimum_magnitude: float = 6.0,
    max_lag_days: float = 365.0,
    max_along_km: float = 2000.0,
    max_offset_km: float = 500.0,
) -> tuple[DataFrame, DataFrame] | None:
    """along_pairs by places: events with us and place, and pairs (place, other) with lag_slabs (0 and 1 for a later slab,
    -1 for the one before), their radius and their route. None where events share places too seldom.
    """
    catalog = _on_steps(events, associations, steps, minimum_magnitude)
    placed, named, shared = places(catalog, ON_STEP, max_lag_days)
    if not shared:
        return None
    envelope = max_along_km + 2 * max_offset_km
    shown = [F.col(f"{side}.{c}").alias(f"{name}_{c}") for side, name in (("l", "earlier"), ("r", "later")) for c in ("boundary_id", "left_plate", "right_plate")]
    flat = close_places(named, envelope, (-1, 0, 1)).select(
        F.col("l.place").alias("place"), F.col("r.place").alias("other"), (F.col("r.slab") - F.col("l.own")).alias("lag_slabs"),
        *shown, F.col("distance_km").alias("radial_distance_km"), *_ends_on_steps(),
    )
    return placed, _with_routes(flat, catalog, steps, envelope, max_along_km)


def along_windows(
    events: DataFrame,
    associations: DataFrame,
    steps: DataFrame,
    found: DataFrame | tuple[DataFrame, DataFrame],
    profile_start: datetime,
    profile_end: datetime,
    minimum_magnitude: float = 6.0,
    days: Sequence[float] = DAYS,
    kilometres: Sequence[float] = KILOMETRES,
) -> DataFrame:
    """Windows of projected sources over routed pairs: counts by route and, of the same pairs, by radius.

    found holds the pairs, or is what routed_places gives for a lag of at least max(days): then no pair is a row.
    """
    along, radial = F.col("along_boundary_distance_km"), F.col("radial_distance_km")
    shared = isinstance(found, tuple)
    near = (found[1] if shared else found).where((F.col("route_status") == AVAILABLE) & (F.least(along, radial) <= max(kilometres)))
    windows_of = {"along_boundary": along, "routed_radial": radial}
    shown = [_smallest(m, kilometres).alias(k) for k, m in windows_of.items()]
    # First by both distance windows; then each measure's own window.
    if shared:
        cells = _cells_of_places(found[0], near.select("place", "other", *shown), tuple(windows_of), days)
    else:
        ends = F.array(*(F.struct(F.col(f"{side}_event_id").alias("source_event_id"), F.lit(side == "earlier").alias("post")) for side in ("earlier", "later")))
        seen = near.where(F.col("lag_days") <= max(days)).select(F.explode(ends).alias("e"), _smallest(F.col("lag_days"), days).alias("time_window_days"), *shown)
        cells = seen.select("e.*", "time_window_days", *windows_of).groupBy("source_event_id", "time_window_days", *windows_of).agg(
            F.count_if(~F.col("post")).alias("pre"), F.count_if("post").alias("post")
        )
    key = ["place", "us"] if shared else ["source_event_id"]
    apart = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("distance_window_km")) for k in windows_of)))
    each = cells.select(*key, "time_window_days", "pre", "post", apart.alias("m")).select("*", "m.*").where("distance_window_km is not null")
    counts = each.groupBy(*key, "time_window_days", "distance_window_km").agg(
        *(
            F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(side))), F.lit(0)).alias(f"{side}_count_{k}")
            for k in windows_of
            for side in ("pre", "post")
        )
    )
    if shared:
        counts = found[0].select(F.col("event_id").alias("source_event_id"), *key).join(counts, key).drop(*key)
    catalog = eligible(events, minimum_magnitude)
    context = ("step_id", "boundary_id", "left_plate", "right_plate", "boundary_class")
    sources = catalog.join(project(catalog, associations, steps).drop("latitude", "longitude"), "event_id").select(
        F.col("event_id").alias("source_event_id"),
        F.col("time").alias("source_time"),
        F.col("magnitude").alias("source_magnitude"),
        F.col("magnitude_type").alias("source_magnitude_type"),
        *(F.col(c).alias(f"source_{c}") for c in context),
        F.col("distance_to_boundary_km").alias("source_distance_to_boundary_km"),
    )
    return _summed(counts, sources, days, kilometres).join(sources, "source_event_id").withColumns(_edges(profile_start, profile_end))


def along_statistics(observations: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Totals of edge-eligible sources by threshold and window."""
    edge = F.col("edge_eligible")
    strata, by = by_threshold(observations, thresholds), ("source_minimum_magnitude", "time_window_days", "distance_window_km")
    made = strata.groupBy(*by).agg(F.count_if(edge).alias("eligible_source_count"), *(c for k in ALONG for c in _totals(k, edge)))
    return _with_medians(made, strata, by, dict.fromkeys(ALONG, edge)).withColumns(_derived(ALONG))


def along_coverage(found: DataFrame, pairs: str | None = None) -> DataFrame:
    """One row: pairs by route status, and medians of routes and of their ratio to the radius.

    A row of found is one pair, or as many as its column pairs says. It is read several times.
    """
    along, radial = F.col("along_boundary_distance_km"), F.col("radial_distance_km")
    n = F.col(pairs) if pairs else F.lit(1)
    ratio = F.when(radial > 0, along / radial)
    counted = cut(found.groupBy("route_status", "within_along_boundary_limit", along.alias("along"), ratio.alias("ratio")).agg(F.sum(n).alias("n")))
    chosen = {
        "candidate_pair_count": F.lit(True),
        "route_available_pair_count": F.col("route_status") == AVAILABLE,
        "within_along_boundary_limit_pair_count": F.col("within_along_boundary_limit"),
        "missing_projection_pair_count": F.col("route_status") == MISSING,
        "different_plate_pair_count": F.col("route_status") == DIFFERENT,
        "disconnected_same_plate_pair_count": F.col("route_status") == DISCONNECTED,
    }
    made = counted.agg(*(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name) for name, c in chosen.items()))
    for value, name in (("along", "median_along_boundary_distance_km"), ("ratio", "median_along_to_radial_ratio")):
        made = made.crossJoin(F.broadcast(_median(counted, value, name)))
    return made


def _median(counted: DataFrame, value: str, name: str) -> DataFrame:
    """One row: the exact median of a column of which each row stands for n. Values are dealt out by ranges; only the
    ranges' totals are summed in one task, and the middle is sought in the range that holds it."""
    ranged = counted.where(F.col(value).isNotNull()).groupBy(value).agg(F.sum("n").alias("n")).repartitionByRange(value)
    ranged = cut(ranged.withColumn("range", F.spark_partition_id()))
    totals = ranged.groupBy("range").agg(F.sum("n").alias("held"))
    totals = totals.withColumns({"before": F.sum("held").over(Window.orderBy("range")) - F.col("held"), "total": F.sum("held").over(Window.partitionBy())})
    low, high = (F.floor((F.col("total") - k) / 2) for k in (1, 0))
    middle = totals.where((F.col("before") <= high) & (F.col("before") + F.col("held") > low))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.join(F.broadcast(middle), "range").withColumn("upto", upto)
    found = placed.agg(*(F.min(F.when(F.col("upto") > at, F.col(value))).alias(x) for x, at in (("low", low), ("high", high))))
    return found.select(((F.col("low") + F.col("high")) / 2).alias(name))


def along_summary(observations: DataFrame, found: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """The along-boundary study as one row: coverage of the pairs, statistics by threshold and window, and their rings.

    The nested tables have a row for each threshold and window, whatever the number of events.
    """
    strata = cut(along_statistics(observations, thresholds))
    parts = {"statistics": strata, "rings": annular(strata, ALONG)}
    made = along_coverage(found).select(F.struct("*").alias("coverage"))
    for name, df in parts.items():
        rows = F.array_sort(F.collect_list(F.struct(*sorted(df.columns, key=lambda c: c not in ("source_minimum_magnitude", "time_window_days")))))
        made = made.crossJoin(F.broadcast(df.agg(rows.alias(name))))
    return made
