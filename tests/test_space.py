"""Geometry, clustering, context, network and pair studies against closed forms and brute force."""

import hashlib
import itertools
import math
import random
import statistics
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tremora.functions import geo
from tremora.operators import context, interaction, network, revisions, skew, spatial
from tremora.plans import dashboard


def km(a, b):
    p, q, r, s = map(math.radians, (*a, *b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


def column(spark, c):
    return spark.range(1).select(c).first()[0]


def test_haversine_and_bearing(spark):
    lits = [F.lit(float(x)) for x in (0, 0, 0, 1)]
    assert column(spark, geo.haversine_km(*lits)) == pytest.approx(111.1950802335329)
    assert column(spark, geo.bearing(*lits)) == pytest.approx(90)
    assert [column(spark, geo.cardinal(F.lit(b))) for b in (0.0, 22.5, 67.5, 359.0)] == ["N", "N", "E", "N"]


def brute_dbscan(points, eps, least):
    near = [[j for j, q in enumerate(points) if km(p, q) <= eps] for p in points]
    label, n = [-1] * len(points), 0
    for k in range(len(points)):
        if label[k] == -1 and len(near[k]) >= least:
            stack = [k]
            while stack:
                i = stack.pop()
                if label[i] == -1:
                    label[i] = n
                    if len(near[i]) >= least:
                        stack += near[i]
            n += 1
    return label


@pytest.mark.parametrize("seed", range(3))
def test_dbscan(spark, seed):
    r = random.Random(seed)
    where = [(80, 179.9), (-10, 20), (0, -180), (89.9, 0)]
    points = [(min(90.0, la + r.gauss(0, 0.1)), (lo + r.gauss(0, 0.2) + 180) % 360 - 180) for la, lo in (r.choice(where) for _ in range(120))]
    points += points[:10]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "position long, latitude double, longitude double")
    got = dict(spatial.dbscan(df, "position", 9.0, 4).collect())
    assert [got[k] for k in range(len(points))] == brute_dbscan(points, 9.0, 4)


def test_dense_spot_costs_no_pairs(spark):
    """20,000 distinct points within 2 km would be 400 million pairs; an arm of single points touches them."""
    r = random.Random(9)
    points = [(10 + r.gauss(0, 0.004), 20 + r.gauss(0, 0.004)) for _ in range(20_000)] + [(10.0, 20.03 + 0.06 * k) for k in range(12)] + [(60.0, 60.0)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "position long, latitude double, longitude double")
    got = dict(spatial.dbscan(df, "position", 9.0, 3).collect())
    assert {got[k] for k in range(20_012)} == {0} and got[20_012] == -1


@pytest.mark.parametrize("seed", range(4))
def test_dbscan_of_touching_cells(spark, seed):
    """Clusters of a few cells each, at a distance around eps, so that facing points don't settle who is linked."""
    r = random.Random(100 + seed)
    points = [(5 + 0.075 * (k % 9) + r.gauss(0, 0.02), 5 + 0.075 * (k // 9 % 9) + r.gauss(0, 0.02)) for k in range(260)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "position long, latitude double, longitude double")
    got = dict(spatial.dbscan(df, "position", 4.0, 4).collect())
    assert [got[k] for k in range(len(points))] == brute_dbscan(points, 4.0, 4)


def test_numbers_in_order(spark):
    values = random.Random(2).sample(range(10**6), 5000)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    got = dict(spatial.in_order(df, "v", "k").collect())
    assert got == {v: k for k, v in enumerate(sorted(values))} and spatial.in_order(df.limit(0), "v", "k").count() == 0


def test_members_and_ids_of_a_large_cluster(spark):
    rows = [(k, 1) for k in range(30_000)] + [(30_000 + k, k % 2 * 5) for k in range(10)] + [(50_000, -1)]
    labelled = spark.createDataFrame(rows, "position long, cluster_id long").repartition(5)
    got = dict(spatial.swarm_ids(spatial.cluster_members(labelled)).collect())
    for c in (0, 1, 5):
        text = "\x1f".join(sorted(str(p) for p, k in rows if k == c))
        assert got[c] == "swarm-" + hashlib.sha256(text.encode()).hexdigest()[:12]
    assert set(got) == {0, 1, 5} and spatial.swarm_ids(spatial.cluster_members(labelled.limit(0))).count() == 0


def test_crowded_keys_are_dealt(spark):
    """A key with a third of all rows goes to many tasks, and the join stays the same."""
    left = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000 + 10).alias("k"), "id")
    right = spark.range(2000).select((F.col("id") % 1100).alias("k"), F.col("id").alias("other"))
    one, every = skew.dealt(left, right, ["k"], most=100)
    assert one.where("k = 7").groupBy("salt").count().agg(F.max("count")).first()[0] < 160 and one.count() == 9000
    joined = one.join(every, ["k", "salt"]).select("id", "other")
    plain = left.join(right, "k").select("id", "other")
    assert joined.exceptAll(plain).count() == plain.exceptAll(joined).count() == 0


def test_swarm(spark):
    rows = [(10 + k, datetime(2024, 1, 1 + k), la, lo, 5.0 + k, 2.0 + k) for k, (la, lo) in enumerate([(18.0, -66.0), (18.0, -65.99), (18.01, -65.99), (18.01, -65.98)])]
    df = spark.createDataFrame(rows, "position long, time timestamp, latitude double, longitude double, depth double, magnitude double")
    s = spatial.swarms(df, spatial.SwarmConfig(eps_km=3.0, stationary_km=0.1)).first()
    assert (s["duration_days"], s["event_rate_per_day"]) == (3.0, pytest.approx(4 / 3))
    assert (s["magnitude_trend"], s["depth_trend"], s["migration_direction"], s["activity_status"]) == ("increasing", "increasing", "NE", "active")
    assert s["swarm_id"] == "swarm-" + hashlib.sha256("\x1f".join(["10", "11", "12", "13"]).encode()).hexdigest()[:12]
    with pytest.raises(Exception, match="reference time"):
        spatial.swarms(df, reference=datetime(2024, 1, 2)).collect()
    assert spatial.swarms(df.limit(0)).count() == 0


def fault(spark, *lines):
    rows = [(f"f{k}", [{"lat": float(a), "lon": float(b)} for a, b in line]) for k, line in enumerate(lines)]
    return context.segments(spark.createDataFrame(rows, "fault_id string, coordinates array<struct<lat:double,lon:double>>"))


def events_at(spark, *points):
    return spark.createDataFrame([(f"e{k}", float(a), float(b)) for k, (a, b) in enumerate(points)], "event_id string, latitude double, longitude double")


def test_nearest_fault(spark):
    segs = fault(spark, [(0, 0), (0, 2)], [(0, 179), (0, -179)], [(40, 40)])
    events = events_at(spark, (0.5, 1), (1, 1), (0.1, 179.5), (40, 40.1), (60, 60))
    got = {r["event_id"]: (r["fault_id"], r["distance_km"]) for r in context.nearest(events, segs, "fault_id", 250.0).collect()}
    assert got["e0"] == ("f0", pytest.approx(55.6, abs=0.3)) and got["e1"] == ("f0", pytest.approx(111.2, abs=0.3))
    assert got["e2"] == ("f1", pytest.approx(11.1, abs=0.1)) and got["e3"][0] == "f2" and "e4" not in got
    assert context.nearest(events, segs, "fault_id", 5.0).count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_index_equals_brute_force(spark, small, monkeypatch):
    """With segments that fit a broadcast, and in two rings with crowded cells."""
    if not small:
        monkeypatch.setattr(context, "fits", lambda df: False)
        monkeypatch.setattr(skew, "MOST", 3)
    r = random.Random(4)
    lines = []
    for _ in range(60):
        a, b = r.uniform(-85, 85), r.uniform(-180, 180)
        lines.append([(a, b), (max(-89, min(89, a + r.uniform(-1, 1))), max(-180, min(180, b + r.uniform(-1, 1))))])
    events = events_at(spark, *((r.uniform(-89, 89), r.uniform(-180, 180)) for _ in range(400)), *((x + r.gauss(0, 0.1), y) for (x, y), _ in lines[:20]))
    segs = fault(spark, *lines)
    indexed, brute = (sorted(map(tuple, context.nearest(events, segs, "fault_id", 400.0, indexed=k).collect())) for k in (True, False))
    assert indexed == brute and len(brute) > 20


STEP = "step_id string, boundary_id string, left_plate string, right_plate string, boundary_class string, start_latitude double, start_longitude double, end_latitude double, end_longitude double, length_km double"


def steps(spark, *more):
    rows = [("s0", "AF-AN", "AF", "AN", "OTF", 0.0, 0.0, 0.0, 1.0, 100.0), ("s1", "AF-AN", "AF", "AN", "OTF", 0.0, 1.0, 0.0, 2.0, 100.0), *more]
    return spark.createDataFrame(rows, STEP)


def test_projection_and_routes(spark):
    branch = ("s2", "NA-PA", "NA", "PA", "SUB", 0.0, 2.0, 1.0, 2.0, 120.0)
    net = steps(spark, branch, ("s9", "AN-AF", "AN", "AF", "OTF", 50.0, 50.0, 50.0, 51.0, 100.0))
    summary = network.network_summary(net).first()
    assert (summary["node_count"], summary["edge_count"], summary["component_count"]) == (6, 4, 2)
    events = events_at(spark, (0.1, 0.5), (-0.1, 1.5), (0.0, -0.5), (0.5, 2.0))
    assoc = spark.createDataFrame([("e0", "s0"), ("e1", "s1"), ("e2", "s0"), ("e3", "s2")], "event_id string, step_id string")
    p = {r["event_id"]: r for r in network.project(events, assoc, net).collect()}
    assert p["e0"]["fraction"] == pytest.approx(0.5) and p["e1"]["distance_to_end_km"] == pytest.approx(50)
    assert p["e2"]["fraction"] == 0 and p["e2"]["distance_to_boundary_km"] == pytest.approx(55.6, abs=0.1)

    def route(a, b, scope):
        row = [("p", p[a]["step_id"], p[a]["distance_from_start_km"], p[a]["distance_to_end_km"], p[b]["step_id"], p[b]["distance_from_start_km"], p[b]["distance_to_end_km"])]
        pairs = spark.createDataFrame(row, "pair_id string, s_step_id string, s_from_start double, s_to_end double, t_step_id string, t_from_start double, t_to_end double")
        return network.routed(pairs, net, scope).first()["along_km"]

    assert route("e0", "e1", "same_plate_pair") == pytest.approx(100) and route("e0", "e0", "all") == 0
    assert route("e1", "e3", "all") == pytest.approx(110) and route("e1", "e3", "same_plate_pair") is None


def random_network(spark, seed):
    """A map with loops, dead ends, parallel steps, a lone ring and long chains, in two plate pairs."""
    r = random.Random(seed)
    where, rows = {}, []

    def spot(n):
        return where.setdefault(n, (round(r.uniform(-60, 60), 3), round(r.uniform(-170, 170), 3)))

    def step(a, b):
        pair = ("AF", "AN") if r.random() < 0.85 else ("NA", "PA")
        if r.random() < 0.5:
            a, b = b, a
        rows.append((f"s{len(rows)}", "-".join(pair), *pair, "OTF", *spot(a), *spot(b), round(r.uniform(1, 90), 3)))

    forks = [f"f{k}" for k in range(9)]
    for k in range(16):
        a, b = r.choice(forks), r.choice(forks)
        chain = [a, *(f"c{k}.{j}" for j in range(r.randrange(5) + (a == b) * 2)), b if r.random() < 0.9 else f"end{k}"]
        for x, y in zip(chain, chain[1:]):
            step(x, y)
    ring = [f"r{j}" for j in range(5)]
    for x, y in zip(ring, ring[1:] + ring[:1]):
        step(x, y)
    return rows, spark.createDataFrame(rows, STEP)


def all_distances(rows, key):
    """Floyd and Warshall within each scope."""
    best = {}
    for row in rows:
        a, b = (",".join(str(x) for x in row[k : k + 2]) for k in (5, 7))
        for x, y in ((a, b), (b, a)):
            best[key(row), x, y] = min(best.get((key(row), x, y), math.inf), row[9])
            best[key(row), x, x] = 0.0
    for scope in {k[0] for k in best}:
        nodes = sorted({k[1] for k in best if k[0] == scope})
        for m in nodes:
            for x in nodes:
                if (scope, x, m) in best:
                    for y in nodes:
                        if (scope, m, y) in best and best[scope, x, m] + best[scope, m, y] < best.get((scope, x, y), math.inf):
                            best[scope, x, y] = best[scope, x, m] + best[scope, m, y]
    return best


@pytest.mark.parametrize("seed", range(3))
def test_contracted_routes_compete(spark, seed, monkeypatch):
    """On maps with loops, distances of contracted networks are those of the whole ones."""
    monkeypatch.setattr(network, "CONTRACTED", 0)
    rows, steps_df = random_network(spark, seed)
    for scope, key in (("all", lambda r: "all"), ("same_plate_pair", lambda r: "|".join(sorted(r[2:4])))):
        expected = all_distances(rows, key)
        r = random.Random(seed)
        nodes = r.sample(sorted({k[:2] for k in expected}), 14)
        sources = spark.createDataFrame(nodes[:8], "scope_key string, n1 string")
        targets = spark.createDataFrame(nodes[6:], "scope_key string, n string")
        got = {(x["scope_key"], x["n1"], x["n2"]): x["km"] for x in network.shortest_paths(steps_df, scope, sources, targets).collect()}
        for s in nodes[:8]:
            for t in nodes[6:]:
                wanted = expected.get((*s, t[1])) if s[0] == t[0] else None
                assert got.get((*s, t[1])) == (None if wanted is None else pytest.approx(wanted)) or s[0] != t[0]
        links = network.edges(steps_df).select(network._scope_key(scope).alias("scope_key"), "a", "b", "length_km")
        needed = targets.unionByName(sources.withColumnRenamed("n1", "n"))
        left = network.contracted(links, needed).collect()
        assert len(left) < len(rows) * 0.8


def test_identical_endpoints_fail(spark):
    with pytest.raises(Exception, match="identical endpoints"):
        network.edges(steps(spark, ("s3", "b", "A", "B", "c", 1.0, 1.0, 1.0, 1.0, 5.0))).collect()


EVENT = "event_id string, time timestamp, magnitude double, magnitude_type string, latitude double, longitude double"


def study(spark, n=160, seed=2):
    r = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    rows = [(f"e{k}", t0 + timedelta(hours=r.randrange(24 * 60)), r.choice([5.9, 6.0, 6.5, 7.2, 8.1, None]), "mww", r.uniform(-2, 2), r.uniform(178, 180) * r.choice([1, -1])) for k in range(n)]
    return rows, spark.createDataFrame(rows, EVENT)


def associations(spark, rows):
    kinds = [("b1", "AF", "AN", "OTF"), ("b2", "AN", "AF", "SUB"), ("b3", "NA", "PA", "SUB")]
    return spark.createDataFrame([(r[0], *kinds[k % 3]) for k, r in enumerate(rows) if k % 4], "event_id string, boundary_id string, left_plate string, right_plate string, boundary_class string")


def test_pairs_match_brute_force(spark):
    rows, events = study(spark)
    assoc = associations(spark, rows)
    ctx = {r["event_id"]: r for r in assoc.collect()}
    strong = [r for r in rows if r[2] is not None and r[2] >= 6]
    expected = {}
    for a in strong:
        for b in strong:
            lag, d = (b[1] - a[1]).total_seconds() / 86400, km(a[4:], b[4:])
            if 0 < lag <= 7 and d <= 200:
                x, y = ctx.get(a[0]), ctx.get(b[0])
                same = None if not (x and y) else sorted(x[2:4]) == sorted(y[2:4])
                expected[a[0], b[0]] = (round(lag, 6), round(d, 3), same)
    got = {(r["source_event_id"], r["target_event_id"]): (round(r["lag_days"], 6), round(r["distance_km"], 3), r["same_plate_pair"]) for r in interaction.pairs(events, assoc, 6.0, 7.0, 200.0).collect()}
    assert got == expected and len(got) > 50
    with pytest.raises(Exception, match="duplicate event_id"):
        interaction.pairs(events, assoc.unionByName(assoc)).collect()


def test_pairs_of_a_planted_cluster(spark, monkeypatch):
    """A third of all events in one cube and one time bucket: many tasks share it, and no pair is lost or doubled."""
    r = random.Random(8)
    t0 = datetime(2024, 1, 1)
    rows = [(f"e{k}", t0 + timedelta(hours=r.randrange(24 * 90)), 6.5, "mww", r.uniform(-60, 60), r.uniform(-180, 180)) for k in range(200)]
    rows += [(f"c{k}", t0 + timedelta(minutes=k), 6.5, "mww", 10 + r.gauss(0, 0.05), 20 + r.gauss(0, 0.05)) for k in range(100)]
    events = spark.createDataFrame(rows, EVENT).cache()
    monkeypatch.setattr(skew, "MOST", 10)
    met = interaction.close_pairs(events, 5.0, 300.0).select(F.col("l.event_id").alias("a"), F.col("r.event_id").alias("b"), F.col("l.salt").alias("salt")).collect()
    expected = {(a[0], b[0]) for a in rows for b in rows if 0 < (b[1] - a[1]).total_seconds() <= 5 * 86400 and km(a[4:], b[4:]) <= 300}
    assert {(x["a"], x["b"]) for x in met} == expected and len(met) == len(expected) >= 4950
    assert len({x["salt"] for x in met if x["a"].startswith("c")}) >= 8


def test_windows_and_rings(spark):
    rows, events = study(spark)
    start, end = datetime(2024, 1, 1), datetime(2024, 3, 1)
    obs = interaction.windows(events, associations(spark, rows), start, end, 6.0, (2.0, 7.0), (100.0, 300.0))
    strong = [r for r in rows if r[2] is not None and r[2] >= 6]
    got = {(r["source_event_id"], r["time_window_days"], r["distance_window_km"]): r for r in obs.collect()}
    assert len(got) == 4 * len(strong)
    for a in strong:
        for t in (2.0, 7.0):
            for d in (100.0, 300.0):
                lags = [(b[1] - a[1]).total_seconds() / 86400 for b in strong if km(a[4:], b[4:]) <= d]
                r = got[a[0], t, d]
                assert r["post_count_all"] == sum(0 < x <= t for x in lags) and r["pre_count_all"] == sum(-t <= x < 0 for x in lags)
                assert r["edge_eligible"] == (a[1] - timedelta(days=t) >= start and a[1] + timedelta(days=t) <= end)
    strata = interaction.stratified(obs, (6.0, 8.0))
    rings = {(r["source_minimum_magnitude"], r["time_window_days"], r["upper_distance_km"]): r for r in interaction.annular(strata).collect()}
    full = {(r["source_minimum_magnitude"], r["time_window_days"], r["distance_window_km"]): r for r in strata.collect()}
    assert rings[6.0, 7.0, 300.0]["post_all_count"] == full[6.0, 7.0, 300.0]["post_all_count"] - full[6.0, 7.0, 100.0]["post_all_count"]


def test_medians_are_exact(spark):
    r = random.Random(6)
    rows = [(w, r.random() < 0.8, r.random() < 0.6, *(r.randrange(4) for _ in range(6))) for w in (1.0, 2.0, 3.0) for _ in range(r.choice([5, 40, 41]))]
    counts = [f"{s}_count_{k}" for k in interaction.RADIAL for s in ("pre", "post")]
    df = spark.createDataFrame([(*x[:1], 9.0, *x[1:]) for x in rows] + [(4.0, 9.0, False, True, *[1] * 6)], ["time_window_days", "distance_window_km", "edge_eligible", "source_has_plate_context", *counts])
    for got in interaction.cumulative(df).collect():
        mine = [x for x in rows if x[0] == got["time_window_days"] and x[1]]
        for n, kind in enumerate(interaction.RADIAL):
            used = [x[4 + 2 * n] - x[3 + 2 * n] for x in mine if kind == "all" or x[2]]
            assert got[f"median_post_minus_pre_{kind}"] == (statistics.median(used) if used else None)


def test_along_boundary(spark):
    t = datetime(2024, 1, 10)
    rows = [("a", t, 7.1, "mww", 0.0, 0.5), ("b", t + timedelta(days=1), 6.5, "mww", 0.0, 1.5), ("c", t + timedelta(days=1), 6.5, "mww", 0.0, 1.6), ("d", t + timedelta(days=2), 6.2, "mb", 0.0, 0.7)]
    events = spark.createDataFrame(rows, EVENT)
    net = steps(spark, ("s2", "NA-PA", "NA", "PA", "SUB", 0.0, 5.0, 1.0, 5.0, 120.0))
    assoc = spark.createDataFrame([("a", "s0", "AF-AN", "AF", "AN", "OTF"), ("b", "s1", "AF-AN", "AF", "AN", "OTF"), ("c", "s2", "NA-PA", "NA", "PA", "SUB")], "event_id string, step_id string, boundary_id string, left_plate string, right_plate string, boundary_class string")
    found = interaction.along_pairs(events, assoc, net, 6.0, 7.0, 500.0, 10.0)
    got = {(r["earlier_event_id"], r["later_event_id"]): r for r in found.collect()}
    assert got["a", "b"]["route_status"] == "available" and got["a", "b"]["along_boundary_distance_km"] == pytest.approx(100)
    assert got["a", "c"]["route_status"] == "different_plate_pair" and got["a", "d"]["route_status"] == "missing_projection"
    obs = interaction.along_windows(events, assoc, net, found, datetime(2024, 1, 1), datetime(2024, 2, 1), 6.0, (2.0,), (105.0,))
    by = {r["source_event_id"]: r for r in obs.collect()}
    assert (by["a"]["post_count_along_boundary"], by["a"]["post_count_routed_radial"]) == (1, 0) and set(by) == {"a", "b", "c"}
    cover = interaction.along_coverage(found).first()
    assert (cover["candidate_pair_count"], cover["route_available_pair_count"], cover["different_plate_pair_count"]) == (5, 1, 1)
    assert interaction.along_statistics(obs, (7.0,)).first()["post_along_boundary_count"] == 1


def test_merge_counts(spark):
    schema = "event_id string, source string, time timestamp, magnitude double, updated_at timestamp"
    t = datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", "us", t, 1.0, t), ("b", "us", t, 2.0, t), ("c", "us", t, 3.0, None)], schema)
    new = spark.createDataFrame([("a", "us", t, 1.5, t + timedelta(1)), ("b", "us", t, 9.0, t - timedelta(1)), ("d", "us", t, 4.0, t)], schema)
    assert tuple(revisions.merge_counts(old, new).first()) == (1, 1, 2, 4)
    assert {r["event_id"]: r["magnitude"] for r in revisions.merge(old, new).collect()} == {"a": 1.5, "b": 2.0, "c": 3.0, "d": 4.0}


def test_dashboard_selections(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0, 5.0), ("b", "c", 3.0, 6.0), ("c", "d", 2.0, 7.0)], "source_event_id string, target_event_id string, lag_days double, distance_km double")
    ids = spark.createDataFrame([("b",), ("c",)], "event_id string")
    assert dashboard.incident_pairs(pairs, ids).count() == 3
    assert [r["signed_lag_days"] for r in dashboard.relationships(pairs, "b").collect()] == [-1.0, 3.0]


def test_range_joins_are_equi_joins(spark, capsys):
    """Neither pair studies nor neighbourhoods may fall back to a nested loop or a cartesian product."""
    rows, events = study(spark)
    interaction.pairs(events, associations(spark, rows)).explain()
    spatial.near_pairs(events, events, 50.0).explain()
    interaction.windows(events, associations(spark, rows), datetime(2024, 1, 1), datetime(2024, 2, 1)).explain()
    context.nearest(events, fault(spark, [(0, 0), (1, 1)]), "fault_id", 100.0).explain()
    assert not {w for w in ("NestedLoop", "Cartesian") if w in capsys.readouterr().out}


def test_research_bundle(spark, tmp_path):
    from tremora.plans import research

    rows, events = study(spark, 25)
    placed = events.withColumns({"latitude": F.col("latitude") / 10, "longitude": F.lit(0.5), "depth": F.lit(5.0)})
    traces = spark.createDataFrame([("f0", [{"lat": 0.0, "lon": 0.0}, {"lat": 0.0, "lon": 2.0}])], "fault_id string, coordinates array<struct<lat:double,lon:double>>")
    tables = research.studies(placed, traces, steps(spark), research.Profile(datetime(2024, 1, 1), datetime(2024, 3, 1)))
    counts = research.write_bundle(tables, str(tmp_path))
    strong = sum(r[2] is not None and r[2] >= 6 for r in rows)
    assert counts["events"] == counts["boundary_associations"] == counts["fault_associations"] == 25
    assert counts["interaction_windows"] == counts["along_windows"] == 25 * strong
    assert counts["interaction_pairs"] == counts["along_pairs"] > 0


def test_near_pairs_of_shared_coordinates(spark, monkeypatch):
    """Rows of equal coordinates meet through spots, in as many tasks as their pairs take, also where one spot has most."""
    r = random.Random(12)
    at = [(k * 0.1 - 2, 179.9 + 0.1 * j) for k in range(5) for j in range(4)]
    rows = [(k, *(at[0] if k % 3 == 0 else r.choice(at))) for k in range(300)] + [(900, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    expected = {(a[0], b[0]) for a in rows[:-1] for b in rows[:-1] if a[0] < b[0] and km(a[1:], b[1:]) <= 12}
    for shared in (1, 10**9):
        monkeypatch.setattr(spatial, "SHARED", shared)
        for work in (skew.WORK, 500):
            monkeypatch.setattr(skew, "WORK", work)
            met = spatial.near_pairs(df, df, 12.0, F.col("l.id") < F.col("r.id"))
            got = met.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), "distance_km").collect()
            assert {(x["a"], x["b"]) for x in got} == expected and len(got) == len(expected)
            assert work > 500 or met.rdd.getNumPartitions() > 40


def test_near_names_of_shared_coordinates(spark, monkeypatch):
    """Names in blocks make the same pairs as rows do: repeated and null names, one spot with most rows, any blocks."""
    r = random.Random(14)
    at = [(k * 0.1 - 2, 179.9 + 0.1 * j) for k in range(5) for j in range(4)]
    rows = [(f"{r.randrange(400)}", *(at[0] if k % 3 == 0 else r.choice(at))) for k in range(300)] + [("900", None, 1.0), (None, *at[0])]
    df = spark.createDataFrame(rows, "id string, latitude double, longitude double")
    known = [x for x in rows if x[0] and x[1] is not None]
    expected = Counter((a[0], b[0], round(km(a[1:], b[1:]), 4)) for a in known for b in known if a[0] < b[0] and km(a[1:], b[1:]) <= 12)
    for shared, block, work, ranges in ((10**9, 64, skew.WORK, 9), (1, 64, skew.WORK, 9), (1, 4, skew.WORK, 9), (1, 4, 500, 2), (1, 1, 500, 9)):
        for module, name, value in ((spatial, "SHARED", shared), (spatial, "BLOCK", block), (skew, "BLOCK", block), (skew, "WORK", work), (spatial, "RANGES", ranges)):
            monkeypatch.setattr(module, name, value)
        met = spatial.near_names(df, "id", 12.0, 4)
        assert Counter(map(tuple, met.collect())) == expected and met.columns == ["a", "b", "distance_km"]
        assert work > 500 or met.rdd.getNumPartitions() > 40
    assert spatial.near_names(df.limit(0), "id", 12.0, 4).count() == 0


def test_haversine_pairs_takes_distances_between_spots(spark, monkeypatch):
    """Neither a distance nor its rounding is left to the step that makes the pairs of the query."""
    from tremora.plans.registry import queries

    monkeypatch.setattr(spatial, "SHARED", 0)
    plan = queries()["haversine_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "explode(held" in plan and not any(x in plan for x in ("round(", "ASIN", "latitude"))


def shared_study(spark):
    """Events that share a few places, some of them exactly a window apart, some at the same moment."""
    r = random.Random(21)
    t0 = datetime(2024, 1, 5)
    at = [(0.03 * k, 0.1 * j) for k in (-1, 0, 1) for j in (1, 4, 9, 14)] + [(60.0, 60.0)]
    rows = [(f"e{k}", t0 + timedelta(hours=6 * r.randrange(48)), r.choice([6.0, 7.2]), "mww", *r.choice(at)) for k in range(150)]
    net = steps(spark, ("s2", "NA-PA", "NA", "PA", "SUB", 0.0, 2.0, 1.0, 2.0, 120.0))
    kinds = [("s0", "AF-AN", "AF", "AN", "OTF"), ("s1", "AF-AN", "AF", "AN", "OTF"), ("s2", "NA-PA", "NA", "PA", "SUB")]
    placed = [(x[0], *kinds[0 if x[5] < 1 else 1 + (x[4] > 0)]) for x in rows if x[4] < 50]
    assoc = spark.createDataFrame(placed, "event_id string, step_id string, boundary_id string, left_plate string, right_plate string, boundary_class string")
    return rows, spark.createDataFrame(rows, EVENT).cache(), assoc.cache(), net


def test_counts_between_places(spark, monkeypatch):
    """Windows, routes and their medians by places are those by pairs, and no pair of events becomes a row."""
    _, events, assoc, net = shared_study(spark)
    bounds, days, near = (datetime(2024, 1, 1), datetime(2024, 2, 1)), (1.0, 2.0, 5.0), (20.0, 60.0)
    limits = (6.0, 5.0, 60.0, 10.0)

    def found(df):
        return sorted(map(str, df.select(*sorted(df.columns)).collect()))

    monkeypatch.setattr(interaction, "SHARED", 10**9)
    pairs = interaction.along_pairs(events, assoc, net, *limits).cache()
    assert interaction.routed_places(events, assoc, net, *limits) is None and pairs.count() > 500
    radial = found(interaction.windows(events, assoc, *bounds, 6.0, days, near))
    along = found(interaction.along_windows(events, assoc, net, pairs, *bounds, 6.0, days, near))
    cover = interaction.along_coverage(pairs).first()
    routes = [x["along_boundary_distance_km"] for x in pairs.where("route_status = 'available'").collect()]
    assert cover["median_along_boundary_distance_km"] == pytest.approx(statistics.median(routes)) and cover["candidate_pair_count"] == pairs.count()
    assert cover["missing_projection_pair_count"] > 0 and cover["different_plate_pair_count"] > 0

    monkeypatch.setattr(interaction, "SHARED", 0)
    monkeypatch.setattr(interaction, "MOMENTS", 3)

    def fail(*_):
        raise AssertionError("pairs of events")

    monkeypatch.setattr(interaction, "close_pairs", fail)
    places = interaction.routed_places(events, assoc, net, *limits)
    assert found(interaction.windows(events, assoc, *bounds, 6.0, days, near)) == radial
    assert found(interaction.along_windows(events, assoc, net, places, *bounds, 6.0, days, near)) == along
    counted = interaction.pairs_of_places(places[0], places[1].where("lag_slabs >= 0"), 5.0)
    assert interaction.along_coverage(counted, "pairs").first() == cover


def test_pairs_show_what_is_made_once_an_event(spark):
    """Plate pairs, moments and columns shown otherwise are made before the join, with the same rows as after it."""
    _, events, assoc, _ = shared_study(spark)
    shown = {"time": F.date_format("time", "MM-dd HH"), "magnitude": F.round(F.col("magnitude") / 3, 2)}
    found = interaction.pairs(events, assoc, 6.0, 5.0, 60.0, shown)
    above = found._jdf.queryExecution().executedPlan().toString().split("ExistingRDD", 1)[0]
    assert "Join" in above and not any(x in above for x in ("date_format", "array_sort", "trim", "/ 3"))
    plain = interaction.pairs(events, assoc, 6.0, 5.0, 60.0)
    after = plain.withColumns({f"{s}_{c}": x for s in ("source", "target") for c, x in (("time", F.date_format(f"{s}_time", "MM-dd HH")), ("magnitude", F.round(F.col(f"{s}_magnitude") / 3, 2)))})
    assert found.columns == plain.columns and found.count() > 500
    assert sorted(map(str, found.collect())) == sorted(map(str, after.collect()))


def test_pairs_along_a_meridian_at_the_limit(spark):
    """Two events due north of each other whose distance is the limit to the last bit are a pair; just below it they aren't."""
    t = datetime(2024, 1, 1)
    for lat, step in ((0.0, 0.53), (-89.9, 0.07), (41.3, 1e-7), (-60.0, 150.0)):
        rows = [("a", t, 6.5, "mww", lat, 7.0), ("b", t + timedelta(hours=1), 6.5, "mww", lat + step, 7.0)]
        events = spark.createDataFrame(rows, EVENT)
        far = interaction.close_pairs(events, 1.0, 20_000.0).first()["distance_km"]
        assert interaction.close_pairs(events, 1.0, far).count() == 1
        assert interaction.close_pairs(events, 1.0, math.nextafter(far, 0)).count() == 0


def test_moments_of_other_places_are_no_rows(spark, monkeypatch):
    """Counts at a place come from searches in arrays, whole and in parts, in any batches: no moment of another place is
    shuffled or put in a window, also where the arrays fit no broadcast; null kinds stay apart."""
    r, day = random.Random(8), 86_400_000_000
    events = [(f"e{k}", k % 4, r.randrange(0, 12) * day // 2) for k in range(90)] + [("x", 0, None)]
    near = [(0, 1, True), (0, 2, None), (0, 3, True), (1, 0, False), (2, 2, None), (3, 1, None)]
    expected = {}
    for (a, b, kind), (_, p, t), (_, q, u) in itertools.product(near, events, events):
        if (p, q) == (a, b) and t is not None and u is not None and 0 < abs(u - t) <= 2 * day:
            expected.setdefault((p, t, 1.0 if abs(u - t) <= day else 2.0, kind), [0, 0])[u > t] += 1
    # An event's counts are those of its moment, whose events have met each other event as often as they are.
    sharing = {(p, t): sum(x[1:] == (p, t) for x in events) for _, p, t in events}
    expected = {k: tuple(n // sharing[k[:2]] for n in v) for k, v in expected.items()}
    placed = spark.createDataFrame(events, "event_id string, place long, us long").cache()
    met = spark.createDataFrame(near, "place long, other long, kind boolean").cache()
    for most, rows, small in ((4096, 10_000, True), (3, 2, True), (3, 4, False)):
        monkeypatch.setattr(interaction, "MOMENTS", most)
        monkeypatch.setattr(interaction, "fits", lambda _, x=small: x)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            cells = interaction._cells_of_places(placed, met, ("kind",), (1.0, 2.0))
            got = {}
            for x in cells.collect():
                key = (x["place"], x["us"], x["time_window_days"], x["kind"])
                pre, post = got.get(key, (0, 0))
                got[key] = (pre + x["pre"], post + x["post"])
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == expected and len(got) > 40
        plan = cells._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Window" not in plan and "Generate" not in plan
        assert not small or "SortMergeJoin" not in plan


def test_routes_take_no_shuffle_of_pairs(spark):
    """Pairs are joined once; their routes come from a broadcast table of steps, and nothing as long as they is stored."""
    _, events, assoc, net = shared_study(spark)
    plan = interaction.along_pairs(events, assoc, net, 6.0, 5.0, 60.0, 10.0)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "BroadcastHashJoin" in joins[0] and "s_step_id" in joins[0] and "lag_days" not in plan.split("Scan ExistingRDD", 1)[1]


def test_along_pairs_by_blocks_of_events(spark, monkeypatch):
    """Pairs made of blocks of any size, dealt to any tasks, are those of single events; what hangs on an event or on two
    places is shown and rounded before they are made."""
    rows, events, assoc, net = shared_study(spark)
    events = events.unionByName(spark.createDataFrame([("n0", None, 7.0, "mww", *rows[0][4:])], EVENT)).withColumn("place", F.lit("by name"))
    lag = {(a[0], b[0]): (b[1] - a[1]).total_seconds() / 86400 for a in rows for b in rows if km(a[4:], b[4:]) <= 80}
    expected = {k: v for k, v in lag.items() if 0 < v <= 5}
    shown = {"time": F.date_format("time", "MM-dd HH"), "magnitude": F.round(F.col("magnitude") / 3, 2)}
    for block, work in ((64, skew.WORK), (1, skew.WORK), (3, 200)):
        monkeypatch.setattr(skew, "BLOCK", block)
        monkeypatch.setattr(skew, "WORK", work)
        plain = interaction.along_pairs(events, assoc, net, 6.0, 5.0, 60.0, 10.0)
        got = plain.collect()
        assert {(x["earlier_event_id"], x["later_event_id"]): x["lag_days"] for x in got} == expected and len(got) == len(expected) > 500
        places = {x[0]: x[4:] for x in rows}
        assert all(x["radial_distance_km"] == pytest.approx(km(places[x["earlier_event_id"]], places[x["later_event_id"]]), abs=1e-9) for x in got)
        found = interaction.along_pairs(events, assoc, net, 6.0, 5.0, 60.0, 10.0, shown, 2)
        assert work > 200 or found.rdd.getNumPartitions() > 30
        after = plain.withColumns({c: F.round(c, 2) for c in ("lag_days", "radial_distance_km", "along_boundary_distance_km")})
        after = after.withColumns({f"{s}_{c}": x for s in ("earlier", "later") for c, x in (("time", F.date_format(f"{s}_time", "MM-dd HH")), ("magnitude", F.round(F.col(f"{s}_magnitude") / 3, 2)))})
        assert found.columns == after.columns and sorted(map(str, found.collect())) == sorted(map(str, after.collect()))
    monkeypatch.setattr(interaction, "SHARED", 0)
    placed, met = interaction.routed_places(events, assoc, net, 6.0, 5.0, 60.0, 10.0)
    counted = interaction.pairs_of_places(placed, met.where("lag_slabs >= 0"), 5.0)
    assert counted.agg(F.sum("pairs")).first()[0] == len(expected)
    above = found._jdf.queryExecution().executedPlan().toString().split("Generate inline(later", 1)[0]
    assert "lag_days" in above and not any(x in above for x in ("round(", "ASIN", "date_format", "/ 3", "Join"))


def test_lags_are_rounded_as_by_decimals(spark):
    """Lags rounded by whole numbers are those that round gives, at every half and beside it."""
    halves = spark.range(60_000).select((F.col("id") * 8_640_000 + 4_320_000).alias("half"))
    us = halves.select(F.explode(F.array(*(F.col("half") + d for d in (-1, 0, 1, 1_234_567)))).alias("us"))
    far = us.select((F.col("us") + F.lit(9_990 * 86_400_000_000)).alias("us"))
    for df in (us, far):
        wrong = df.where(interaction._days(F.col("us"), 10_000, 4) != F.round(F.col("us") / interaction.DAY, 4))
        assert wrong.count() == 0
    assert column(spark, interaction._days(F.lit(4_320_000), 5.0, 4)) == 0.0001
    assert column(spark, interaction._days(F.lit(86_400_000_000 // 2), 5.0, None)) == 0.5


def test_lags_are_exact(spark):
    """An event exactly a window's length later lies within it, whatever the day."""
    t = [datetime(2024, 1, 1) + timedelta(microseconds=k * 987_654_321) for k in range(400)]
    rows = [(f"{s}{k}", x + timedelta(days=d), 6.5, "mww", float(k % 90), k / 3) for k, x in enumerate(t) for s, d in (("a", 0), ("b", 5))]
    met = interaction.close_pairs(spark.createDataFrame(rows, EVENT), 5.0, 1.0).select(F.col("l.event_id").alias("a"), F.col("r.event_id").alias("b"), "lag_days")
    got = {x["a"]: x["lag_days"] for x in met.collect() if x["a"][1:] == x["b"][1:]}
    assert len(got) == 400 and set(got.values()) == {5.0}
