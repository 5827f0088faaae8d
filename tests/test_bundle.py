"""Named outputs and bundles: files, casts, reopening a study, checks of projections."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tremora.operators import context, interaction, network
from tremora.plans import bundle, dashboard, research

T0 = datetime(2020, 3, 1)


def test_casts(spark):
    rows = [("1.5", "true"), ("", " YES "), ("inf", "0"), ("abc", None), (None, "1"), ("-7", ""), ("2020-01-01 00:00", "no"), ("2020-01-01T0 1", "x")]
    df = spark.createDataFrame(rows, "v string, b string").coalesce(1)
    got = df.select(
        bundle.finite(F.col("v")).alias("f"), bundle.whole(F.col("v")).alias("w"), bundle.flag(F.col("b")).alias("b"), bundle.iso_time(F.col("v")).alias("t")
    ).collect()
    assert [r["f"] for r in got] == [1.5, None, None, None, None, -7.0, None, None]
    assert [r["w"] for r in got] == [1, None, None, None, None, -7, None, None]
    assert [r["b"] for r in got] == [True, True, False, False, True, False, False, False]
    assert [r["t"] for r in got] == ["1.5", None, "inf", "abc", None, "-7", "2020-01-01T00:00", "2020-01-01T0 1"]


def located(spark):
    rows = [(f"e{k}", T0 + timedelta(hours=9 * k), 6.0 + k % 4 / 2, "mww", 18.02, -66.9 + k * 0.1, 10.0) for k in range(12)]
    return spark.createDataFrame(
        rows, "event_id string, time timestamp, magnitude double, magnitude_type string, latitude double, longitude double, depth double"
    )


def steps(spark):
    rows = [(f"s{k}", "B", "NA", "CA", "SUB", 18.0, -67.0 + k, 18.0, -66.0 + k, 105.7) for k in range(2)]
    names = "start_latitude double, start_longitude double, end_latitude double, end_longitude double, length_km double"
    return spark.createDataFrame(rows, f"step_id string, boundary_id string, left_plate string, right_plate string, boundary_class string, {names}")


def test_files_and_reports(spark, tmp_path):
    events = located(spark).select("event_id", F.col("time").alias("event_time_utc"), "magnitude", F.col("depth").alias("depth_km"))
    stem = bundle.catalog_stem("pr", 2020, 2021)
    assert stem == "pr_2020_2021_earthquakes"
    paths = bundle.write_catalog_files(events, events.agg(F.count("*").alias("n")), stem, str(tmp_path / "raw"), str(tmp_path / "done"))
    assert spark.read.json(paths["raw"]).count() == spark.read.parquet(paths["parquet"]).count() == 12
    assert spark.read.option("header", True).csv(paths["csv"]).count() == 12 and spark.read.json(paths["summary"]).first()["n"] == 12


def test_associations_keep_na(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("event_id,step_id,boundary_id,left_plate,right_plate,boundary_class,polarity,distance_km,source\ne,s,B,NA,CA,SUB,,1.5,pb\n")
    row = bundle.read_associations_csv(spark, str(path)).first()
    assert (row["left_plate"], row["polarity"], row["distance_km"]) == ("NA", None, 1.5)


def test_bundle_is_reopened_and_brought_up_to_date(spark, tmp_path):
    folder, events, lines = str(tmp_path / "bundle"), located(spark), steps(spark)
    with pytest.raises(FileNotFoundError):
        bundle.open_bundle(spark, folder)
    bundle.write_tables({"events": events, "boundary_associations": context.nearest_boundary(events, lines, 100.0), "steps": lines}, folder, csv=True)
    bundle.write_metadata(spark, folder, {"bundle_schema_version": 4, "profile": {"start": "2020-02-01", "end": "2020-04-01"}})
    with pytest.raises(ValueError):
        bundle.open_bundle(spark, folder, version=bundle.BUNDLE_VERSION)
    made = bundle.restudy_along(spark, folder)
    assert made["bundle_schema_version"] == 5 == bundle.read_metadata(spark, folder)["bundle_schema_version"]
    kept = bundle.open_bundle(spark, folder, bundle.ALONG_TABLES, bundle.BUNDLE_VERSION)
    assert kept["along_pairs"].count() == made["along_boundary"]["rows"]["along_pairs"] == 66
    assert dashboard.decay_series(kept["along_strata"], 7.0, 100.0).count() == 5
    assert spark.read.option("header", True).csv(f"{folder}/steps.csv").first()["left_plate"] == "NA"


def test_study_round_trip(spark, tmp_path, monkeypatch):
    """What write_bundle writes can be opened and studied again; a failure between tables leaves the old version."""
    folder, events, lines = str(tmp_path / "bundle"), located(spark), steps(spark)
    traces = spark.createDataFrame([("f0", [{"lat": 18.0, "lon": -67.0}, {"lat": 18.0, "lon": -66.0}])], "fault_id string, coordinates array<struct<lat:double,lon:double>>")
    profile = research.Profile(datetime(2020, 2, 1), datetime(2020, 4, 1))
    tables = research.studies(events, traces, lines, profile)
    counts = research.write_bundle(tables, folder, profile, {"steps": {"title": "made up"}})
    first = bundle.current(spark, folder)
    assert first.number == 1 and first.metadata["rows"] == counts and first.metadata["sources"]["steps"] == {"title": "made up"}
    before = {n: spark.read.parquet(first.tables[n]).collect() for n in bundle.ALONG_TABLES}
    made = bundle.restudy_along(spark, folder, 7.0)
    second = bundle.current(spark, folder)
    assert second.number == 2 and made["along_boundary"]["minimum_magnitude"] == 7.0
    assert second.tables["events"] == first.tables["events"] and second.tables["along_pairs"] != first.tables["along_pairs"]
    assert 0 < made["along_boundary"]["rows"]["along_pairs"] < counts["along_pairs"] == len(before["along_pairs"])

    written, real = [], DataFrameWriter.parquet

    def failing(self, path, *args, **how):
        written.append(path)
        if len(written) == 3:
            raise OSError("disk full")
        return real(self, path, *args, **how)

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(OSError, match="disk full"):
        bundle.restudy_along(spark, folder, 6.5)
    monkeypatch.undo()
    assert bundle.current(spark, folder) == second
    kept = bundle.open_bundle(spark, folder, bundle.ALONG_TABLES, bundle.BUNDLE_VERSION)
    assert kept["along_pairs"].count() == made["along_boundary"]["rows"]["along_pairs"]
    with pytest.raises(RuntimeError, match="another version"):
        bundle.commit(spark, folder, first, {"steps": lines}, {})
    opened = bundle.open_bundle(spark, folder, second.tables)
    shown = dashboard.write_dashboard(opened, str(tmp_path / "shown"))
    row = spark.read.json(str(tmp_path / "shown/overview.json")).first()
    assert (row["event_count"], row["m7_count"], row["m8_count"], row["plate_coverage_percent"], row["first_year"]) == (12, 6, 0, 100.0, 2020)
    assert shown["events"] == 12 and shown["overview"] == 1 and shown["major_windows"] == 6 * 25 and 0 < shown["major_pairs"] <= counts["interaction_pairs"]
    assert json.loads(spark.read.text(str(tmp_path / "shown/manifest.json")).first()["value"])["rows"] == shown
    summary = interaction.along_summary(opened["along_windows"], opened["along_pairs"]).first()
    assert len(summary["statistics"]) == made["along_boundary"]["rows"]["along_strata"] and summary["coverage"]["candidate_pair_count"] == made["along_boundary"]["rows"]["along_pairs"]
    assert dashboard.overview(events.limit(0).withColumns({"boundary_id": F.lit("b"), "fault_id": F.lit("f")})).first()["plate_coverage_percent"] is None
    paths = bundle.export_tables(spark, folder, str(tmp_path / "out"), ["steps", "along_strata"])
    assert [spark.read.option("header", True).csv(x).count() for x in paths] == [2, made["along_boundary"]["rows"]["along_strata"]]
    typed = bundle.read_exported(spark, str(tmp_path / "out"), {"steps": "step_id string, left_plate string, length_km double"})["steps"]
    assert sorted(map(tuple, typed.collect())) == [("s0", "NA", 105.7), ("s1", "NA", 105.7)]
    bundle.export_tables(spark, folder, str(tmp_path / "out"), ["events"], "json")
    shown = bundle.read_exported(spark, str(tmp_path / "out"), {"events": "event_id string, time timestamp, magnitude double"}, "json")["events"]
    assert shown.exceptAll(events.select("event_id", "time", "magnitude")).count() == 0 and shown.count() == 12
    for name, columns, wrong in (("none", "a string", FileNotFoundError), ("steps", "colour string", ValueError)):
        with pytest.raises(wrong):
            bundle.read_exported(spark, str(tmp_path / "out"), {name: columns})
    assert research.write_bundle({"steps": lines}, folder) == {"steps": 2} and bundle.current(spark, folder).number == 3


@pytest.mark.parametrize("wrong", [(), (0.0, 1.0), (-1.0,), (float("inf"),), (float("nan"),)])
def test_wrong_windows(wrong):
    with pytest.raises(ValueError, match="positive and finite"):
        interaction.window_limits(wrong)
    assert interaction.window_limits((2, 1, 2.0)) == [1.0, 2.0]


def test_activity_report_files(spark, tmp_path):
    rows = [(f"e{k}", T0 + timedelta(hours=9 * k), 4.0 + k % 4, 5.0) for k in range(12)]
    events = spark.createDataFrame(rows, "event_id string, event_time_utc timestamp, magnitude double, depth_km double")
    paths = bundle.write_activity_report(events, str(tmp_path), "pr")
    days = spark.read.option("header", True).csv(paths["daily_activity"])
    assert days.count() == 5 and days.agg(F.sum(F.col("event_count").cast("int"))).first()[0] == 12
    assert spark.read.json(paths["summary"]).first()["total_events"] == 12


def test_projections_are_checked(spark):
    events, lines = located(spark), steps(spark)
    good = network.project(events, context.nearest_boundary(events, lines, 100.0), lines)
    assert network.checked_projections(good, lines).count() == 12
    wrong = {
        "unknown step": {"step_id": F.lit("none")},
        "tectonic fields": {"left_plate": F.lit("XX")},
        "distances": {"distance_to_end_km": F.col("distance_to_end_km") + 1},
        "fraction": {"fraction": F.col("fraction") + 0.01},
    }
    for said, change in wrong.items():
        with pytest.raises(Exception, match=said):
            network.checked_projections(good.withColumns(change), lines).collect()
