"""Daily tables, summaries and baselines on small catalogs with known results."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tremora.functions import seismic, status
from tremora.operators import baseline, daily, trend, validation
from tremora.plans import report


def activity(spark):
    rows = [("eq1", "01T01:00", 1.2), ("eq2", "01T12:00", 2.4), ("eq3", "02T06:00", 3.2), ("eq4", "04T08:00", 4.8), ("eq5", "04T22:00", 1.5)]
    return spark.createDataFrame([(i, "USGS", f"2024-01-{t}Z", m) for i, t, m in rows], "event_id string, source string, event_time_utc string, magnitude double")


def test_daily_activity(spark):
    days = daily.daily_activity(activity(spark)).orderBy("date").collect()
    assert [r["event_count"] for r in days] == [2, 1, 0, 2]
    assert (days[0]["magnitude_1_plus"], days[0]["magnitude_2_plus"], days[0]["magnitude_3_plus"]) == (2, 1, 0)
    assert days[2]["maximum_magnitude"] is None and days[3]["magnitude_4_plus"] == 1
    assert daily.daily_activity(activity(spark), False).count() == 3


def test_rolling_activity(spark):
    rolled = daily.rolling_activity(daily.daily_activity(activity(spark))).orderBy("date").collect()
    assert [r["event_count_7d"] for r in rolled] == [2, 3, 3, 5]
    assert [r["daily_average_7d"] for r in rolled] == [2.0, 1.5, 1.0, 1.25]
    assert [r["historical_expanding_average"] for r in rolled] == [None, 2.0, 1.5, 1.0]
    assert [r["activity_ratio_7d"] for r in rolled] == [None, 0.75, 0.6667, 1.25]


def test_activity_summary(spark):
    s = daily.activity_summary(daily.daily_activity(activity(spark))).first()
    assert (s["total_events"], s["active_days"], s["calendar_days"], s["maximum_events_in_one_day"]) == (5, 3, 4, 2)
    assert (s["busiest_day"], s["average_events_per_day"], s["median_events_per_day"]) == ("2024-01-01", 1.25, 1.5)
    empty = daily.activity_summary(daily.daily_activity(activity(spark).limit(0))).first()
    assert empty["total_events"] == 0 and empty["busiest_day"] is None


def test_keep_last_and_coercion(spark):
    rows = [("a", "u", "2024-01-01", "1.0"), ("a", "u", "2024-01-02", "x"), (None, "u", "2024-01-02", "2"), ("b", "u", None, "2")]
    df = spark.createDataFrame(rows, "event_id string, source string, event_time_utc string, magnitude string").coalesce(1)
    got = validation.validated(df).collect()
    assert [(r["event_id"], r["event_time_utc"].day, r["magnitude"]) for r in got] == [("a", 2, None)]
    with pytest.raises(ValueError, match="magnitude"):
        validation.validated(df.drop("magnitude"))


def test_energy(spark):
    rows = [("eq1", "01 01", 1.0), ("eq2", "01 12", 2.0), ("eq3", "03 06", 3.0), ("eq4", "04 08", None)]
    df = spark.createDataFrame([(i, f"2024-01-{t}:00:00", m) for i, t, m in rows], "event_id string, event_time_utc string, magnitude double")
    days = daily.daily_energy(df).orderBy("date").collect()
    assert days[0]["total_energy_joules"] == pytest.approx(65090996.76298817)
    assert [days[k]["total_energy_joules"] for k in (1, 3)] == [0.0, 0.0] and days[3]["average_energy_joules"] is None
    s = daily.energy_summary(df).first()
    assert (s["event_count_with_magnitude"], s["maximum_energy_event_id"], s["maximum_energy_magnitude"]) == (3, "eq3", 3.0)
    assert s["total_energy_joules"] == pytest.approx(2060353311.731871) and s["equivalent_single_magnitude"] == 3.0093


def test_depth(spark):
    rows = [("eq1", "01 01", 10.0), ("eq2", "01 12", 80.0), ("eq3", "03 06", 350.0), ("eq4", "04 08", None), ("eq5", "04 10", 25.0)]
    df = spark.createDataFrame([(i, f"2024-01-{t}:00:00", d) for i, t, d in rows], "event_id string, event_time_utc string, depth_km double")
    first, second = daily.daily_depth(df).orderBy("date").take(2)
    assert (first["average_depth_km"], first["shallow_events"], first["intermediate_events"], first["depth_standard_deviation_km"]) == (45.0, 1, 1, 49.497)
    assert second["event_count"] == 0
    s = daily.depth_summary(df).first()
    assert (s["events_with_depth"], s["average_depth_km"], s["median_depth_km"], s["depth_standard_deviation_km"]) == (4, 116.25, 52.5, 158.712)
    assert (s["shallowest_event_id"], s["deepest_event_id"]) == ("eq1", "eq3")


def test_magnitude(spark):
    rows = [(0.8, "01 01"), (1.4, "01 12"), (2.6, "03 06"), (3.5, "04 08"), (4.7, "04 10"), (None, "04 12")]
    df = spark.createDataFrame([(f"eq{k + 1}", f"2024-01-{t}:00:00", m, f"Location {'ABCDEF'[k]}") for k, (m, t) in enumerate(rows)], "event_id string, event_time_utc string, magnitude double, place string")
    days = daily.daily_magnitude(df).orderBy("date").collect()
    assert (days[0]["average_magnitude"], days[0]["magnitude_standard_deviation"], days[3]["missing_magnitude_count"]) == (1.1, 0.4243, 1)
    s = daily.magnitude_summary(df).first()
    assert (s["largest_event_id"], s["largest_event_place"], s["magnitude_standard_deviation"]) == ("eq5", "Location E", 1.5732)
    assert daily.magnitude_summary(df.where("magnitude is null")).first()["largest_event_id"] is None


def test_history_ignores_the_future(spark):
    df = activity(spark)
    later = df.unionByName(spark.createDataFrame([("z", "USGS", "2024-02-01T00:00Z", 7.0)], df.schema))
    a = daily.rolling_activity(daily.daily_activity(df)).orderBy("date").collect()
    assert daily.rolling_activity(daily.daily_activity(later)).orderBy("date").take(len(a)) == a


@pytest.mark.parametrize(
    "ratio,name",
    [(0.2, "very_quiet"), (0.49, "very_quiet"), (0.5, "quiet"), (0.79, "quiet"), (0.8, "normal"), (1.2, "normal"), (1.21, "elevated"), (1.75, "elevated"), (1.76, "exceptional"), (None, "unavailable")],
)
def test_ratio_status(spark, ratio, name):
    assert spark.range(1).select(status.ratio_status(F.lit(ratio).cast("double"), status.ACTIVITY)).first()[0] == name


def test_confidence_and_bands(spark):
    row = spark.range(1).select(
        *(status.confidence(F.lit(n)).alias(f"c{n}") for n in (29, 30, 180, 730)),
        seismic.magnitude_band(F.lit(4.99)).alias("band"),
        seismic.depth_class(F.lit(300.0)).alias("depth"),
        seismic.seismic_moment(F.lit(6.0), F.lit(" MWW ")).alias("moment"),
        seismic.seismic_moment(F.lit(6.0), F.lit("mb")).alias("none"),
        status.overall(F.lit("normal"), F.lit("unavailable"), F.lit("elevated")).alias("all"),
    ).first()
    assert tuple(row)[:6] == ("Very Low", "Low", "Moderate", "High", "4_to_4_9", "deep")
    assert row["moment"] == pytest.approx(10**18.1) and row["none"] is None and row["all"] == "elevated"


def test_forty_day_report(spark):
    rows = [
        (f"e{d}-{k}", "u", datetime(2024, 1, 1 + d, k) if d < 31 else datetime(2024, 2, d - 30, k), 1.5 + 0.5 * k, 12.0 + k)
        for d in range(40)
        for k in range(3 if d >= 33 else 1)
    ]
    df = spark.createDataFrame(rows, "event_id string, source string, event_time_utc timestamp, magnitude double, depth_km double")
    r = report.observatory_report(df).first()
    assert (r["activity_period"]["total_events"], r["activity_period"]["calendar_days"], r["activity"]["event_count_7d"]) == (54, 40, 21)
    assert r["magnitude_period"]["maximum_magnitude"] == 2.5 and r["activity"]["activity_ratio_7d"] == 2.2941
    assert (r["activity_status"], r["confidence"], r["overall_status"]) == ("exceptional", "Low", "exceptional")
    text = report.render(r)
    assert "exceptional" in text and '"activity_status":"exceptional"' in report.as_json(report.observatory_report(df)).first()[0]
    assert report.observatory_report(df.limit(0)).count() == 0


def test_baseline_periods(spark):
    df = spark.createDataFrame([("2024-01-01T01:00:00Z", 0.0, 0.0), ("2024-01-03T02:00:00-05:00", 2.0, 10.0), (None, 1.0, 1.0)], "time string, magnitude double, depth double")
    periods = baseline.period_summaries(df).orderBy("period_start").collect()
    assert [p["event_count"] for p in periods] == [1, 0, 1]
    assert [p["rolling_event_count_mean"] for p in periods] == pytest.approx([1, 0.5, 2 / 3])
    assert periods[1]["mean_magnitude"] is None and periods[1]["total_energy_joules"] is None
    spread = {r["metric"]: r for r in baseline.distributions(baseline.period_summaries(df)).collect()}
    assert len(spread) == 17 and spread["event_count"]["mean"] == pytest.approx(2 / 3)
    with pytest.raises(TypeError):
        baseline.period_summaries(df.withColumn("magnitude", F.lit(True)))
    with pytest.raises(Exception, match="finite"):
        baseline.period_summaries(df.withColumn("depth", F.lit(float("nan")))).collect()


def test_comparison_with_an_empty_period(spark):
    df = spark.createDataFrame([(f"2024-01-0{d}", 1.0, 1.0) for d in (1, 2, 3)], "time string, magnitude double, depth double")
    got = {r["metric"]: r for r in baseline.compare(df, baseline.period_summaries(df), datetime(2024, 1, 8), datetime(2024, 1, 15)).collect()}
    count = got["event_count"]
    assert (count["current_value"], count["percentile_rank"], count["ratio"]) == (0.0, 0.0, 0.0)
    assert got["mean_magnitude"]["classification"] == "unavailable"


def compared(spark, rows):
    return spark.createDataFrame([("p", *r) for r in rows], "k string, metric string, current_value double, mean double, percentile_rank double")


@pytest.mark.parametrize("rank,one,two", [(0, 0, 100), (25, 0, 50), (50, 0, 0), (75, 50, 50), (100, 100, 100)])
def test_raw_scores(spark, rank, one, two):
    config = baseline.AnomalyConfig((baseline.MetricWeight("a", 1.0), baseline.MetricWeight("b", 1.0, True)))
    got = {r["metric"]: r["raw_score"] for r in baseline.scored(compared(spark, [("a", 1.0, 1.0, float(rank)), ("b", 1.0, 1.0, float(rank))]), ["k"], config).collect()}
    assert got == {"a": one, "b": two}


def test_weights_and_levels(spark):
    config = baseline.AnomalyConfig(tuple(baseline.MetricWeight(n, w) for n, w in (("a", 2.0), ("b", 3.0), ("c", 5.0))))
    rows = [("a", 1.0, 1.0, 75.0), ("b", None, 1.0, None), ("c", 3.0, 1.0, 100.0)]
    r = baseline.anomaly_scores(compared(spark, rows), ["k"], config).first()
    assert r["score"] == pytest.approx(85.71428571428572) and (r["level"], r["strongest_metric"]) == ("elevated", "c")
    none = baseline.anomaly_scores(compared(spark, [("a", None, None, None)]), ["k"], config).first()
    assert none["score"] is None and none["level"] == "unavailable"
    levels = spark.createDataFrame([(59.9,), (60.0,), (80.0,), (95.0,)], "s double").select(baseline.level(F.col("s"))).collect()
    assert [x[0] for x in levels] == ["typical", "noteworthy", "elevated", "extreme"]


def points(spark, scores):
    return spark.createDataFrame([(datetime(2024, 1, 1 + k), datetime(2024, 1, 2 + k), s) for k, s in enumerate(scores)], "period_start timestamp, period_end timestamp, score double")


@pytest.mark.parametrize(
    "scores,slope,direction,ups,downs,percent,momentum",
    [
        ([10.0, 20.0, 30.0, 40.0], 10, "rapidly_increasing", 3, 0, 300, 15),
        ([80.0, 60.0, 40.0, 20.0], -20, "rapidly_decreasing", 0, 3, -75, -30),
        ([25.0, 25.0, 25.0], 0, "stable", 0, 0, 0, 0),
    ],
)
def test_trend(spark, scores, slope, direction, ups, downs, percent, momentum):
    r = trend.trend(points(spark, scores)).first()
    assert r["current_slope"] == pytest.approx(slope) and r["direction"] == direction
    assert (r["consecutive_increases"], r["consecutive_decreases"]) == (ups, downs)
    assert r["percent_change"] == pytest.approx(percent) and r["momentum"] == pytest.approx(momentum)


def test_trend_gaps_windows_and_ties(spark):
    config = trend.TrendConfig(short_window=2, medium_window=3, long_window=4)
    got = trend.moving_averages(points(spark, [10.0, None, 30.0, 50.0]), config).orderBy("period_start").collect()
    assert [r["short_moving_average"] for r in got] == [10, 10, 20, 40]
    r = trend.trend(points(spark, [0.0, 2.0, 4.0, 10.0, 14.0, 18.0]), trend.TrendConfig(slope_window=3, previous_slope_window=3)).first()
    assert (r["previous_slope"], r["current_slope"], r["acceleration"], r["percent_change"]) == (2, 4, 2, None)
    r = trend.trend(points(spark, [10.0, 20.0, 20.0, 10.0])).first()
    assert (r["maximum_period_start"].day, r["minimum_period_start"].day) == (2, 1)
    assert trend.trend(points(spark, [1.0]).limit(0)).first()["direction"] == "insufficient_data"


def test_time_series(spark):
    rows = [(datetime(2024, 1, 1 + d, 12), 2.0, 5.0) for d in range(12)]
    df = spark.createDataFrame(rows, "time timestamp, magnitude double, depth double")
    config = trend.SeriesConfig(lookback=3, minimum_periods=2)
    series = trend.time_series(df, config).orderBy("period_start").collect()
    assert len(series) == 10 and all(r["is_available"] for r in series)
    assert series[0]["period_start"].date() == date(2024, 1, 3) and series[0]["baseline_start"].date() == date(2023, 12, 31)
    later = df.unionByName(spark.createDataFrame([(datetime(2024, 1, 20), 8.0, 1.0)], df.schema))
    assert trend.time_series(later, config).orderBy("period_start").take(10) == series
    weekly = trend.SeriesConfig(lookback=10, minimum_periods=2, baseline=baseline.BaselineConfig("weekly"))
    assert trend.time_series(df, weekly).where("is_available").count() == 10
    s = trend.intelligence(trend.time_series(df, config)).first()
    assert s["available_period_count"] == 10 and s["confidence"] == "moderate"
