"""Files, feeds, planner, stream and command line, all offline."""

import hashlib
import json
import os
from datetime import UTC, datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread
from urllib.error import HTTPError
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tremora.plans import report
from tremora.sources import boundaries, catalogs, fdsn, geojson, pinned, verified
from tremora.sources.schemas import CATALOG
from tremora.streaming import catalog_stream

T0 = datetime(2020, 1, 1)


def feature(i, lon, lat, depth, **p):
    return {"type": "Feature", "id": i, "geometry": {"type": "Point", "coordinates": [lon, lat, depth]}, "properties": p}


def feed(tmp_path):
    ms = 1577880000000
    made = [
        feature("same", -66, 18, 10, mag=1.0, time=ms, updated=ms, net="us", type="earthquake"),
        feature("same", -66, 18, 10, mag="1.5", time=ms, updated=ms + 60000, net="us"),
        feature("later", -66, 18, 5, mag=2.0, time="2020-01-02T00:00:00Z", net="us"),
        feature("nomag", -66, 18, 5, mag=None, time=ms),
        feature("badtime", -66, 18, 5, mag=1, time="never"),
    ]
    path = tmp_path / "feed.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": made}))
    return str(path)


def test_ingest(spark, tmp_path):
    features = geojson.read_features(spark, feed(tmp_path))
    events, counts = geojson.ingest(features, T0, datetime(2020, 1, 3), (17, 20, -69, -63.5), 0.0)
    got = {r["event_id"]: r["magnitude"] for r in events.collect()}
    assert got == {"same": 1.5, "later": 2.0}
    c = counts.first()
    assert (c["incomplete"], c["invalid"], c["duplicates"], c["final_count"]) == (1, 1, 1, 2)
    assert geojson.parse_lenient(features).count() == 3
    with pytest.raises(Exception, match="missing required"):
        geojson.parse_strict(features).collect()


def catalog(spark, rows):
    full = [(i, t, 18.0, -66.0, 5.0, m, "ml", "x", "ok", "earthquake", "us", u) for i, t, m, u in rows]
    return spark.createDataFrame(full, CATALOG)


def test_store_update_and_exports(spark, tmp_path):
    store = catalogs.CatalogStore(spark, str(tmp_path / "store"))
    assert store.load("Puerto Rico").count() == 0
    store.save("Puerto Rico", catalog(spark, [("a", T0, 1.0, T0), ("b", T0, 2.0, T0)]))
    incoming = catalog(spark, [("a", T0, 1.0, T0), ("b", T0, 2.5, T0 + timedelta(1)), ("c", T0, 3.0, T0), ("old", T0 - timedelta(9), 3.0, T0)])
    counts = store.update("puerto_rico", incoming, T0, T0 + timedelta(2)).first()
    assert (counts["downloaded"], counts["inserted"], counts["updated"], counts["unchanged"], counts["final_count"]) == (4, 1, 1, 1, 3)
    assert store.load("puerto-rico", T0, T0).count() == 0 and store.load("puerto-rico", T0).count() == 3
    for suffix in ("csv", "parquet", "json", "orc"):
        path = str(tmp_path / f"out.{suffix}")
        catalogs.write_catalog(store.load("puerto rico"), path)
        assert catalogs.read_catalog(spark, path).select("time").dtypes == [("time", "timestamp")]
    catalogs.export_csv(store.load("puerto rico"), str(tmp_path / "export"))
    assert spark.read.csv(str(tmp_path / "export"), header=True).columns == list(catalogs.EXPORT_COLUMNS)
    with pytest.raises(ValueError):
        catalogs.read_catalog(spark, "x.xlsx")
    assert catalogs.to_observatory(store.load("puerto rico")).columns[1] == "event_time_utc"


def held(store, region="pr"):
    return {r["event_id"]: r["magnitude"] for r in store.load(region).collect()}


def test_two_writers_keep_both_updates(spark, tmp_path, monkeypatch):
    """A second upsert is published while the first one merges: in another month, in the same one, and of the same event."""
    store = catalogs.CatalogStore(spark, str(tmp_path / "store"))
    store.save("pr", catalog(spark, [("a", T0, 1.0, T0), ("b", T0 + timedelta(60), 2.0, T0)]))
    real, waiting, merges = catalogs.CatalogStore._write, [], []

    def interrupted(self, region, df):
        merges.append(1)
        written = real(self, region, df)
        if waiting:
            store.upsert("pr", waiting.pop())
        return written

    monkeypatch.setattr(catalogs.CatalogStore, "_write", interrupted)

    def both(first, second):
        merges.clear()
        waiting.append(catalog(spark, second))
        counts = store.upsert("pr", catalog(spark, first))
        return len(merges), counts["final_count"]

    other_month = both([("c", T0, 3.0, T0)], [("d", T0 + timedelta(60), 4.0, T0)])
    assert other_month[0] == 2 and held(store) == {"a": 1.0, "b": 2.0, "c": 3.0, "d": 4.0}
    same_month = both([("e", T0, 5.0, T0)], [("f", T0, 6.0, T0)])
    assert same_month == (3, 6) and held(store).keys() == set("abcdef")
    same_event = both([("g", T0, 7.0, T0)], [("g", T0 + timedelta(200), 7.5, T0 + timedelta(300))])
    assert same_event[0] == 3 and held(store)["g"] == 7.5 and store.load("pr").count() == 7
    store.vacuum("pr")
    assert store.load("pr").count() == 7 and store.snapshot("pr").version == 7


def test_upsert_reads_touched_months_only(spark, tmp_path):
    """The other months' files could be gone; an event that moves to another month leaves its old one."""
    store = catalogs.CatalogStore(spark, str(tmp_path / "store"))
    store.save("pr", catalog(spark, [(f"e{k}", T0 + timedelta(31 * k), 1.0, T0) for k in range(6)]))
    away = [f for m, f in store.months("pr").items() if m in ("2020-02", "2020-04")]
    for f in away:
        (tmp_path / "hidden").mkdir(exist_ok=True)
        os.rename(f, tmp_path / "hidden" / f.rsplit("month=", 1)[-1])
    counts = store.upsert("pr", catalog(spark, [("e0", T0 + timedelta(70), 4.0, T0 + timedelta(99)), ("new", T0, 2.0, T0)]))
    assert counts == {"inserted": 1, "updated": 1, "unchanged": 5, "final_count": 7}
    for f in away:
        os.rename(tmp_path / "hidden" / f.rsplit("month=", 1)[-1], f)
    got = {r["event_id"]: (r["time"], r["magnitude"]) for r in store.load("pr").collect()}
    assert len(got) == 7 and got["e0"] == (T0 + timedelta(70), 4.0)


def test_many_small_upserts(spark, tmp_path, monkeypatch):
    """The index is made one part from time to time, and says the same as the events."""
    monkeypatch.setattr(catalogs, "PARTS", 3)
    store = catalogs.CatalogStore(spark, str(tmp_path / "store"))
    for k in range(6):
        store.upsert("pr", catalog(spark, [("moving", T0 + timedelta(31 * k), float(k), T0 + timedelta(k)), (f"e{k}", T0, 1.0, T0)]))
    assert held(store) == {"moving": 5.0} | {f"e{k}": 1.0 for k in range(6)}
    now = store.snapshot("pr")
    assert len(now.index) <= 3 and sum(n for _, n in now.months.values()) == 7
    indexed = {r["event_id"]: r["month"] for r in store._indexed(now.index).collect()}
    assert indexed == {r["event_id"]: r["time"].strftime("%Y-%m") for r in store.load("pr").collect()}
    store.save("pr", catalog(spark, []))
    assert store.load("pr").count() == 0 and store.upsert("pr", catalog(spark, []))["final_count"] == 0


def test_regions_and_latest(spark, tmp_path):
    box = catalogs.Region("pr", "PR", (17.0, 20.0, -69.0, -63.5))
    assert catalogs.infer_region("puerto_rico_2020_x", {"puerto": box, "puerto_rico": box}, "d") == "puerto_rico"
    assert catalogs.infer_region("zz", {"puerto": box}, "d") == "d"
    for name in ("a_earthquakes.parquet", "b_earthquakes.parquet", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert catalogs.latest_catalog(spark, str(tmp_path)).endswith("_earthquakes.parquet")
    with pytest.raises(FileNotFoundError):
        catalogs.latest_catalog(spark, str(tmp_path), "*.none")


def test_faults(spark, tmp_path):
    made = [
        {"id": "f1", "geometry": {"type": "LineString", "coordinates": [[0, 1], [2, 3]]}, "properties": {"NAME": "One"}},
        {"geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[5, 5], [6, 6]]]}, "properties": {"Fault_ID": "f2"}},
        {"id": "p", "geometry": {"type": "Point", "coordinates": [0, 0]}, "properties": {}},
    ]
    path = tmp_path / "faults.json"
    path.write_text(json.dumps({"features": made}))
    got = geojson.read_faults(spark, str(path)).collect()
    assert [(r["fault_id"], r["name"]) for r in got] == [("f1", "One"), ("f2:part-1", None), ("f2:part-2", None)]
    assert (got[0]["coordinates"][0]["lat"], got[0]["coordinates"][0]["lon"]) == (1.0, 0.0)


def test_steps(spark):
    lines = ["1 AF-AN -0.4 -54.8 0.5 -54.7 60.5 80 13.2 66 10 2 -4000 2 :OTF*", ": 2: :NA/PA 190 50 -170 51 90 1 2 3 4 5 -1 181 SUB".removeprefix(": ")]
    got = boundaries.parse_steps(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    a, b = got
    assert (a["step_id"], a["left_plate"], a["polarity"], a["right_plate"], a["boundary_class"], a["in_orogen"], a["velocity"], a["age"]) == ("pb2002-step-0001", "AF", "-", "AN", "OTF", True, 13.2, 2.0)
    assert (b["left_plate"], b["start_longitude"], b["age"]) == ("NA", -170.0, None)
    with pytest.raises(Exception, match="not a step"):
        boundaries.parse_steps(spark.createDataFrame([("1 2 3",)], "value string")).collect()


def test_step_features_cross_the_date_line(spark):
    df = spark.createDataFrame([("s", 0.0, 179.0, 2.0, -179.0)], "step_id string, start_latitude double, start_longitude double, end_latitude double, end_longitude double")
    made = json.loads(geojson.step_features(df).first()["feature"])
    assert made["geometry"]["type"] == "MultiLineString" and made["geometry"]["coordinates"][0][1] == [180.0, 1.0]


def test_planner():
    q = fdsn.EventQuery(T0, T0 + timedelta(days=4))
    assert fdsn.plan(q, lambda _: 10) == [q] and fdsn.plan(q, lambda _: 0) == []
    by_day = fdsn.plan(q, lambda x: 10_000 * max(1, (x.end - x.start).days))
    assert [p.end - p.start for p in by_day] == [timedelta(days=1)] * 4
    day = fdsn.EventQuery(T0, T0 + timedelta(days=1))
    assert len(fdsn.plan(day, lambda x: 20_000 if x.north - x.south > 90 else 5)) == 4
    for bad in (lambda _: -1, lambda _: 10**6):
        with pytest.raises(ValueError):
            fdsn.plan(day, bad)
    assert len(fdsn.months(2020, 2021)) == 24


class Reply:
    def __init__(self, body):
        self.body = body

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def read(self):
        return self.body


def test_fetch_retries_and_pages():
    pauses, codes = [], [503, 429]

    def opener(url, timeout):
        if codes:
            raise HTTPError(url, codes.pop(), "x", None, None)
        return Reply(b"ok")

    assert fdsn.fetch("http://x", opener, pauses.append) == b"ok" and pauses == [1.0, 2.0]
    with pytest.raises(HTTPError):
        fdsn.fetch("http://x", lambda u, timeout: (_ for _ in ()).throw(HTTPError(u, 404, "x", None, None)), pauses.append)
    bodies = [{"features": [{"id": 1}, {"id": 2}]}, {"features": [{"id": 3}]}]
    urls = []

    def get(url):
        urls.append(url)
        return json.dumps(bodies[len(urls) - 1]).encode()

    q = fdsn.EventQuery(T0, T0 + timedelta(1))
    assert len(list(fdsn.pages("http://x", q, get, 2))) == 3 and "offset=3" in urls[1]
    with pytest.raises(ValueError, match="repeats"):
        list(fdsn.pages("http://x", q, lambda _: json.dumps(bodies[0]).encode(), 2))


def test_checksums(spark, tmp_path):
    content = b"data\n"
    sha = hashlib.sha1(b"blob 5\0data\n").hexdigest()
    assert verified.blob_sha1(content) == sha
    assert spark.createDataFrame([(content,)], "b binary").select(verified.blob_sha1_column(F.col("b"))).first()[0] == sha
    assert verified.download_verified("u", sha, tmp_path / "x", lambda _: content).read_bytes() == content
    with pytest.raises(ValueError):
        verified.download_verified("u", "0", tmp_path / "y", lambda _: content)
    assert not (tmp_path / "y").exists()


def test_pins_gate_rows(spark, tmp_path):
    """Right, wrong, missing and malformed pins, read by the executors; citations and configuration errors."""
    lines = tmp_path / "steps.txt"
    lines.write_text("1 AF-AN -0.4 -54.8 0.5 -54.7 60.5 80 13.2 66 10 2 -4000 2 :OTF*\n")
    faults = tmp_path / "faults.json"
    line = {"type": "Feature", "id": "f1", "geometry": {"type": "LineString", "coordinates": [[0, 1], [2, 3]]}, "properties": {"name": "One"}}
    faults.write_text(json.dumps({"type": "FeatureCollection", "features": [line]}))

    def configured(**shas):
        found = {"faults": {"gem_global_active_faults": {"raw_url": faults.as_uri()}}, "plate_boundaries": {"bird_pb2002": {"raw_url": lines.as_uri(), "citation": {"title": "t"}, "role": "r", "doi": "d", "license": ""}}}
        found["faults"]["gem_global_active_faults"]["observed_git_blob_sha"] = shas.get("faults") or verified.blob_sha1(faults.read_bytes())
        found["plate_boundaries"]["bird_pb2002"]["observed_git_blob_sha"] = shas.get("steps") or verified.blob_sha1(lines.read_bytes()).upper()
        path = tmp_path / "sources.json"
        path.write_text(json.dumps(found))
        return pinned.load_sources(spark, str(path))

    good = configured()
    assert [r["step_id"] for r in pinned.pinned_steps(spark, good).collect()] == ["pb2002-step-0001"]
    assert [(r["fault_id"], r["coordinates"][1]["lat"]) for r in pinned.pinned_faults(spark, good).collect()] == [("f1", 3.0)]
    with pytest.raises(Exception, match="has checksum"):
        pinned.pinned_steps(spark, configured(steps="0" * 40)).collect()
    with pytest.raises(Exception, match="40 digits"):
        pinned.pinned_steps(spark, configured(steps="abc"))
    gone = pinned.Pin("x", (tmp_path / "none").as_uri(), "0" * 40)
    with pytest.raises(Exception, match="none"):
        pinned.read_pinned(spark, [gone]).collect()
    with pytest.raises(Exception, match="not UTF-8 JSON|not a FeatureCollection"):
        pinned.read_pinned(spark, [pinned.pin(good, *pinned.PB2002)], "features").collect()
    assert pinned.citation(good, *pinned.PB2002)["doi"] == "d" and "license" not in pinned.citation(good, *pinned.PB2002)
    assert pinned.citation(pinned.DEFAULTS, *pinned.GEM)["license"] == "CC-BY-SA-4.0"
    for wrong in (lambda: pinned.citation(good, *pinned.GEM), lambda: pinned.source(good, "faults", "none"), lambda: pinned.pin({"a": {"b": {}}}, "a", "b")):
        with pytest.raises(pinned.SourceError):
            wrong()
    content = faults.read_bytes()
    target = pinned.download_faults(tmp_path / "got.json", good, lambda _: content)
    assert target.read_bytes() == content
    other = b'{"type": "Feature"}'
    with pytest.raises(pinned.SourceError, match="FeatureCollection"):
        pinned.download_geojson("u", verified.blob_sha1(other), tmp_path / "no.json", lambda _: other)
    assert not (tmp_path / "no.json").exists() and pinned.download_steps(tmp_path / "s.txt", good, lambda _: lines.read_bytes()).exists()


def serve(tmp_path, features):
    """A service of one answer, on this machine: count and query."""

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            asked = parse_qs(urlparse(self.path).query)
            first, last = (datetime.fromisoformat(asked[k][0]) for k in ("starttime", "endtime"))
            at = int(asked.get("offset", ["1"])[0]) - 1
            chosen = [f for f in features if first <= datetime.fromtimestamp(f["properties"]["time"] / 1000, UTC).replace(tzinfo=None) < last]
            body = {"count": len(chosen)} if "/count" in self.path else {"features": chosen[at : at + int(asked["limit"][0])]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_port}"


def test_downloads_and_builds(spark, tmp_path, monkeypatch, capsys):
    """All three ways to ask give one merged, ordered catalog; a request that reaches the limit is an error."""
    from tremora import cli

    ms = int(datetime(2020, 1, 31, 22, tzinfo=UTC).timestamp() * 1000)
    made = [feature(f"e{k}", -66 + k / 10, 18, 10, mag=2.0 + k, time=ms + k * 3_600_000, updated=ms, net="us") for k in range(5)]
    made.append(feature("e1", -66, 18, 10, mag=9.0, time=ms + 3_600_000, updated=ms + 10**9, net="us"))
    server, url = serve(tmp_path, made)
    try:
        query = fdsn.EventQuery(datetime(2020, 1, 15), datetime(2020, 3, 2))
        assert [(q.start.day, q.end.month) for q in fdsn.monthly(query)] == [(15, 2), (1, 3), (1, 3)]
        for by in ("planned", "month", "whole"):
            got = [(r["event_id"], r["magnitude"]) for r in fdsn.download(spark, url, query, by).collect()]
            assert got == [("e0", 2.0), ("e1", 9.0), ("e2", 4.0), ("e3", 5.0), ("e4", 6.0)]
        with pytest.raises(ValueError, match="limit"):
            fdsn.single(url, query, fdsn.fetch, 6)
        assert len(fdsn.single(url, query, fdsn.fetch, 7)) == 6
        box = {"min_latitude": 17, "max_latitude": 20, "min_longitude": -69, "max_longitude": -63.5}
        regions = tmp_path / "regions.json"
        regions.write_text(json.dumps({"default_region": "puerto-rico", "regions": {"Puerto Rico": {"name": "PR", "bounds": box, "default_minimum_magnitude": 1.0}, "off": {"enabled": False}}}))
        monkeypatch.setattr(cli, "build_session", lambda: spark)
        store = str(tmp_path / "store")
        cli.main(["build", url, store, str(regions), "--start-year", "2020", "--end-year", "2020", "--by", "month", "--reports", str(tmp_path / "r")])
        assert "'final_count': 5" in capsys.readouterr().out
        assert spark.read.option("header", True).csv(str(tmp_path / "r/puerto_rico_daily_activity.csv")).count() == 2
        cli.main(["report", store, "--store", "--region", "Puerto Rico", "--end", "2020-02-01T00:00:00"])
        said = capsys.readouterr().out
        assert "Observatory report: Puerto Rico" in said and "2020-01-31" in said
        stored = report.stored_report(catalogs.CatalogStore(spark, store), "puerto rico").first()
        assert stored["catalog"]["event_count"] == 5 and stored["region"] == "puerto rico"
    finally:
        server.shutdown()


@pytest.mark.parametrize(
    "change",
    [{"regions": {}}, {"regions": []}, {"default_region": "none"}, {"regions": {"a": {"bounds": {"min_latitude": 1}}}},
     {"regions": {"a": {"bounds": {"min_latitude": 5, "max_latitude": 1, "min_longitude": 0, "max_longitude": 1}}}}],
)
def test_wrong_region_dictionaries(spark, tmp_path, change):
    box = {"min_latitude": 0, "max_latitude": 1, "min_longitude": 0, "max_longitude": 1}
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"default_region": "a", "regions": {"a": {"bounds": box}}}))
    found, default = catalogs.region_dictionary(spark, str(path))
    assert default == "a" and found["a"].box == (0.0, 1.0, 0.0, 1.0)
    path.write_text(json.dumps({"default_region": "a", "regions": {"a": {"bounds": box}}} | change))
    with pytest.raises(ValueError):
        catalogs.region_dictionary(spark, str(path))


def test_study_from_addresses(spark, tmp_path, monkeypatch, capsys):
    """Events from a service, faults and steps from pinned files, to a bundle with citations."""
    from tremora import cli
    from tremora.plans import bundle

    ms = int(datetime(2020, 2, 1, tzinfo=UTC).timestamp() * 1000)
    made = [feature(f"e{k}", 0.5 + k / 20, 0.1, 10, mag=6.0 + k / 4, time=ms + k * 86_400_000, updated=ms, net="us", magType="mww") for k in range(8)]
    lines, traces = tmp_path / "steps.txt", tmp_path / "faults.json"
    lines.write_text("1 AF-AN 0 0 1 0 111 90 13 66 10 2 -4000 2 OTF\n2 AF-AN 1 0 2 0 111 90 13 66 10 2 -4000 2 OTF\n")
    line = {"type": "Feature", "id": "f1", "geometry": {"type": "LineString", "coordinates": [[0, 0], [2, 0]]}, "properties": {}}
    traces.write_text(json.dumps({"type": "FeatureCollection", "features": [line]}))
    said = {
        section: {key: {"raw_url": path.as_uri(), "observed_git_blob_sha": verified.blob_sha1(path.read_bytes()), "citation": {"title": key}}}
        for (section, key), path in ((pinned.GEM, traces), (pinned.PB2002, lines))
    }
    (tmp_path / "sources.json").write_text(json.dumps(said))
    server, url = serve(tmp_path, made)
    monkeypatch.setattr(cli, "build_session", lambda: spark)
    out = str(tmp_path / "bundle")
    try:
        cli.main(["research-download", url, out, "--start", "2020-01-15", "--end", "2020-03-01", "--by", "month", "--sources", str(tmp_path / "sources.json")])
    finally:
        server.shutdown()
    assert "interaction_pairs: 28 rows" in capsys.readouterr().out
    found = bundle.current(spark, out)
    assert found.metadata["sources"]["plate_boundaries.bird_pb2002"]["citation"] == {"title": "bird_pb2002"} and found.metadata["rows"]["events"] == 8
    cli.main(["restudy", out, "--minimum-magnitude", "6.5"])
    cli.main(["dashboard", out, str(tmp_path / "shown")])
    assert "events: 8 rows" in capsys.readouterr().out and bundle.current(spark, out).number == 2


def test_documents(spark):
    df = spark.createDataFrame([("a", datetime(2020, 1, 1, 5), None, [1.5])], "k string, t timestamp, x double, v array<double>")
    row = report.documents(df, "k").first()
    assert row["k"] == "a" and json.loads(row["value"]) == {"k": "a", "t": "2020-01-01T05:00:00Z", "x": None, "v": [1.5]}


def test_wrong_queries():
    for wrong in ({"south": -91.0}, {"east": 181.0}, {"minimum_magnitude": float("nan")}, {"minimum_magnitude": -3.0}, {"start": T0 + timedelta(9)}, {"end": datetime(2021, 1, 1, tzinfo=UTC)}):
        with pytest.raises(ValueError):
            fdsn.EventQuery(**{"start": T0, "end": T0 + timedelta(1)} | wrong)


def test_stream_upsert_and_counts(spark, tmp_path):
    folder = str(tmp_path / "in")
    catalog(spark, [("a", T0, 1.0, T0), ("b", T0 + timedelta(40), 2.0, T0)]).write.parquet(folder)
    store = catalogs.CatalogStore(spark, str(tmp_path / "store"))
    for late in ([], [("a", T0, 1.7, T0 + timedelta(90))]):
        if late:
            catalog(spark, late).write.mode("append").parquet(folder)
        catalog_stream.upsert_stream(catalog_stream.read_stream(spark, folder), store, "pr", str(tmp_path / "c")).awaitTermination()
    assert {r["event_id"]: r["magnitude"] for r in store.load("pr").collect()} == {"a": 1.7, "b": 2.0}
    days = catalog_stream.daily_counts(catalog_stream.read_stream(spark, folder))
    q = days.writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["event_count"] for r in spark.sql("select * from days").collect()] == [1]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from tremora import cli

    path = str(tmp_path / "c.parquet")
    catalog(spark, [(f"e{k}", T0 + timedelta(k), 2.0 + k % 3, T0) for k in range(20)]).write.parquet(path)
    monkeypatch.setattr(cli, "build_session", lambda: spark)
    cli.main(["report", path, "--json", str(tmp_path / "r"), "--intelligence"])
    assert "Observatory report" in capsys.readouterr().out
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()[0])["trend"]["available_count"] == 13
    cli.main(["export", path, str(tmp_path / "e.csv")])
    assert spark.read.csv(str(tmp_path / "e.csv"), header=True).count() == 20


def test_failed_save_keeps_the_old_catalog(spark, tmp_path, monkeypatch):
    store = catalogs.CatalogStore(spark, str(tmp_path / "store"))
    store.save("pr", catalog(spark, [("a", T0, 1.0, T0)]))

    def broken(self, source, target):
        raise OSError("no rename")

    with monkeypatch.context() as patch:
        patch.setattr(catalogs.CatalogStore, "_rename", broken)
        with pytest.raises(OSError):
            store.save("pr", catalog(spark, [("b", T0, 2.0, T0)]))
    assert [r["event_id"] for r in store.load("pr").collect()] == ["a"]
    store.save("pr", store.load("pr").unionByName(catalog(spark, [("b", T0, 2.0, T0)])))
    store.vacuum("pr")
    assert sorted(r["event_id"] for r in store.load("pr").collect()) == ["a", "b"]


def test_upsert_writes_touched_months_only(spark, tmp_path):
    store = catalogs.CatalogStore(spark, str(tmp_path / "store"))
    later, much_later = T0 + timedelta(40), T0 + timedelta(80)
    store.save("pr", catalog(spark, [("a", T0, 1.0, T0), ("b", later, 2.0, T0), ("c", much_later, 3.0, T0)]))
    before = store.months("pr")
    assert len(before) == 3
    # A revision moves b from its month to the first one.
    store.upsert("pr", catalog(spark, [("b", T0, 2.5, later)]))
    after = store.months("pr")
    assert {r["event_id"]: (r["time"], r["magnitude"]) for r in store.load("pr").collect()} == {
        "a": (T0, 1.0), "b": (T0, 2.5), "c": (much_later, 3.0),
    }
    kept = {m for m in before if after.get(m) == before[m]}
    assert kept == {max(before)}
    assert store.load("pr", later, much_later).count() == 0
