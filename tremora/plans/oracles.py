"""DuckDB SQL by query name, written from the definitions and apart from the Spark code."""

from __future__ import annotations

from tremora.plans.adapters import duck

STEPS = ", ".join(f"count(*) filter (magnitude >= {k}) as magnitude_{k}_plus" for k in range(1, 6))
STEP_NAMES = [f"magnitude_{k}_plus" for k in range(1, 6)]


def _rounded(columns: dict[str, str], digits: int = 4) -> str:
    return ", ".join(f"round({e}, {digits}) as {n}" for n, e in columns.items())


def _even(columns: dict[str, str], digits: int) -> str:
    return ", ".join(f"round_even({e}, {digits}) as {n}" for n, e in columns.items())


def _filled(zero: list[str], null: list[str]) -> str:
    """Days d with the table g joined to the spine of days."""
    shown = [f"coalesce(g.{c}, 0) as {c}" for c in zero] + [f"g.{c}" for c in null]
    return f"""
select s.date, {", ".join(shown)}
from (select cast(unnest(generate_series(min(date)::timestamp, max(date)::timestamp, interval 1 day)) as date) as date from g) s
left join g on g.date = s.date"""


_DAY = "cast(event_time_utc as date) as date, count(event_id) as event_count"
_ACTIVITY = f"""select {_DAY}, {STEPS}, {_rounded({'maximum_magnitude': 'max(magnitude)', 'average_magnitude': 'avg(magnitude)', 'median_magnitude': 'median(magnitude)'})}
from catalog group by 1"""
_ACTIVITY_FULL = _filled(["event_count", *STEP_NAMES], ["maximum_magnitude", "average_magnitude", "median_magnitude"])
_LAST = {7: "order by date rows between 6 preceding and current row", 30: "order by date rows between 29 preceding and current row"}
_BEFORE = "order by date rows between unbounded preceding and 1 preceding"
_ENERGY_DAY = f"""select {_DAY}, count(magnitude) as events_with_magnitude,
  coalesce(sum(pow(10, 1.5 * magnitude + 4.8)), 0) as total, avg(pow(10, 1.5 * magnitude + 4.8)) as mean, max(pow(10, 1.5 * magnitude + 4.8)) as high
from catalog group by 1"""

ORACLES: dict[str, str] = {
    "daily_activity": duck(_ACTIVITY_FULL, "catalog", g=_ACTIVITY),
    "daily_activity_sparse": duck("select * from g", "catalog", g=_ACTIVITY),
    "rolling_activity": duck(
        f"""select *, cast(sum(event_count) over ({_LAST[7]}) as bigint) as event_count_7d,
  cast(sum(event_count) over ({_LAST[30]}) as bigint) as event_count_30d,
  round_even(avg(event_count) over ({_LAST[7]}), 4) as daily_average_7d,
  round_even(avg(event_count) over ({_LAST[30]}), 4) as daily_average_30d,
  round_even(avg(event_count) over ({_BEFORE}), 4) as historical_expanding_average,
  round_even(avg(event_count) over ({_LAST[7]}) / nullif(avg(event_count) over ({_BEFORE}), 0), 4) as activity_ratio_7d,
  round_even(avg(event_count) over ({_LAST[30]}) / nullif(avg(event_count) over ({_BEFORE}), 0), 4) as activity_ratio_30d
from f""",
        "catalog", g=_ACTIVITY, f=_ACTIVITY_FULL,
    ),
    "activity_summary": duck(
        f"""select cast(sum(event_count) as bigint) as total_events, count(*) filter (event_count > 0) as active_days,
  count(*) as calendar_days, round(avg(event_count), 3) as average_events_per_day,
  round(median(event_count), 3) as median_events_per_day, max(event_count) as maximum_events_in_one_day,
  (select strftime(date, '%Y-%m-%d') from f order by event_count desc, date limit 1) as busiest_day,
  {", ".join(f"cast(sum({c}) as bigint) as {c}" for c in STEP_NAMES)} from f""",
        "catalog", g=_ACTIVITY, f=_ACTIVITY_FULL,
    ),
    "magnitude_bands": duck(
        f"""select case when magnitude is null then 'unavailable' when magnitude < 1 then 'below_1' when magnitude < 2 then '1_to_1_9'
  when magnitude < 3 then '2_to_2_9' when magnitude < 4 then '3_to_3_9' when magnitude < 5 then '4_to_4_9' else '5_plus' end as magnitude_band,
  count(*) as n, {STEPS} from catalog group by 1""",
        "catalog",
    ),
    "daily_magnitude": duck(
        f"""select {_DAY}, count(magnitude) as events_with_magnitude, count(*) - count(magnitude) as missing_magnitude_count,
  {_even({'average_magnitude': 'avg(magnitude)', 'median_magnitude': 'median(magnitude)', 'minimum_magnitude': 'min(magnitude)', 'maximum_magnitude': 'max(magnitude)', 'magnitude_standard_deviation': 'stddev_samp(magnitude)'}, 4)},
  {STEPS} from catalog group by 1""",
        "catalog",
    ),
    "rolling_magnitude": duck(
        f"""select date, average_magnitude, maximum_magnitude,
  round_even(avg(average_magnitude) over ({_BEFORE}), 4) as historical_expanding_average_magnitude,
  """
        + ", ".join(
            f"""round_even(avg(average_magnitude) over ({_LAST[n]}), 4) as average_magnitude_{n}d,
  round_even(max(maximum_magnitude) over ({_LAST[n]}), 4) as maximum_magnitude_{n}d,
  round_even(avg(average_magnitude) over ({_LAST[n]}) - avg(average_magnitude) over ({_BEFORE}), 4) as average_magnitude_difference_{n}d"""
            for n in (7, 30)
        )
        + " from f",
        "catalog", g=_ACTIVITY, f=_ACTIVITY_FULL,
    ),
    "magnitude_summary": duck(
        f"""select count(*) as total_events, count(magnitude) as events_with_magnitude, count(*) - count(magnitude) as missing_magnitude_count,
  {_rounded({'average_magnitude': 'avg(magnitude)', 'median_magnitude': 'median(magnitude)', 'minimum_magnitude': 'min(magnitude)', 'maximum_magnitude': 'max(magnitude)', 'magnitude_standard_deviation': 'stddev_samp(magnitude)'})},
  {STEPS}, max(l.event_id) as largest_event_id, strftime(max(l.event_time_utc), '%Y-%m-%d %H:%M:%S') as largest_event_time_utc, max(l.place) as largest_event_place
from (select *, magnitude as m from catalog) catalog,
  (select event_id, event_time_utc, place from catalog where magnitude is not null order by magnitude desc, event_time_utc, event_id limit 1) l""",
        "catalog",
    ).replace("count(magnitude)", "count(m)").replace("(magnitude)", "(m)").replace("filter (magnitude", "filter (m"),
    "depth_classes": duck(
        """select case when depth_km < 70 then 'shallow' when depth_km < 300 then 'intermediate' when depth_km >= 300 then 'deep' end as depth_category,
  count(*) as n from catalog group by 1""",
        "catalog",
    ),
    "daily_depth": duck(
        f"""select {_DAY}, count(depth_km) as events_with_depth,
  {_even({'average_depth_km': 'avg(depth_km)', 'median_depth_km': 'median(depth_km)', 'minimum_depth_km': 'min(depth_km)', 'maximum_depth_km': 'max(depth_km)', 'depth_standard_deviation_km': 'stddev_samp(depth_km)'}, 3)},
  count(*) filter (depth_km < 70) as shallow_events, count(*) filter (depth_km >= 70 and depth_km < 300) as intermediate_events,
  count(*) filter (depth_km >= 300) as deep_events from catalog group by 1""",
        "catalog",
    ),
    "rolling_depth": duck(
        f"""select date, average_depth_km, round_even(avg(average_depth_km) over ({_BEFORE}), 4) as historical_expanding_depth_average_km,
  """
        + ", ".join(
            f"""round_even(avg(average_depth_km) over ({_LAST[n]}), 4) as average_depth_{n}d_km,
  round_even(avg(average_depth_km) over ({_LAST[n]}) - avg(average_depth_km) over ({_BEFORE}), 4) as depth_difference_{n}d_km"""
            for n in (7, 30)
        )
        + " from g",
        "catalog", g=f"select {_DAY}, round_even(avg(depth_km), 3) as average_depth_km from catalog group by 1",
    ),
    "depth_summary": duck(
        f"""select count(depth_km) as events_with_depth,
  {_rounded({'average_depth_km': 'avg(depth_km)', 'median_depth_km': 'median(depth_km)', 'minimum_depth_km': 'min(depth_km)', 'maximum_depth_km': 'max(depth_km)', 'depth_standard_deviation_km': 'stddev_samp(depth_km)'}, 3)},
  count(*) filter (depth_km < 70) as shallow_events, count(*) filter (depth_km >= 70 and depth_km < 300) as intermediate_events,
  count(*) filter (depth_km >= 300) as deep_events,
  (select event_id from catalog where depth_km is not null order by depth_km, event_time_utc, event_id limit 1) as shallowest_event_id,
  (select event_id from catalog where depth_km is not null order by depth_km desc, event_time_utc, event_id limit 1) as deepest_event_id
from catalog""",
        "catalog",
    ),
    "event_energy": duck(
        "select event_id, round(magnitude, 4) as magnitude, round(pow(10, 1.5 * magnitude + 4.8) / 1e9, 4) as estimated_energy_joules from catalog",
        "catalog",
    ),
    "daily_energy": duck(
        """select date, event_count, events_with_magnitude, round(total / 1e9, 4) as total_energy_joules, round(mean / 1e9, 4) as average_energy_joules,
  round(high / 1e9, 4) as maximum_event_energy_joules, round(case when total > 0 then (log10(total) - 4.8) / 1.5 end, 4) as equivalent_single_magnitude from g""",
        "catalog", g=_ENERGY_DAY,
    ),
    "rolling_energy": duck(
        f"""select date, round(total / 1e9, 4) as total_energy_joules,
  round(avg(total) over ({_BEFORE}) / 1e9, 4) as historical_expanding_energy_average_joules, """
        + ", ".join(
            f"""round(sum(total) over ({_LAST[n]}) / 1e9, 4) as total_energy_{n}d_joules,
  round(avg(total) over ({_LAST[n]}) / 1e9, 4) as daily_average_energy_{n}d_joules,
  round(avg(total) over ({_LAST[n]}) / nullif(avg(total) over ({_BEFORE}), 0), 4) as energy_ratio_{n}d"""
            for n in (7, 30)
        )
        + " from g",
        "catalog", g=_ENERGY_DAY,
    ),
    "energy_summary": duck(
        """select count(e) as event_count_with_magnitude, round(sum(e) / 1e9, 4) as total_energy_joules, round(avg(e) / 1e9, 4) as average_energy_joules,
  round(median(e) / 1e9, 4) as median_energy_joules, round(max(e) / 1e9, 4) as maximum_event_energy_joules,
  (select round(magnitude, 4) from g where e is not null order by e desc, event_time_utc, event_id limit 1) as maximum_energy_magnitude,
  (select event_id from g where e is not null order by e desc, event_time_utc, event_id limit 1) as maximum_energy_event_id,
  round((log10(sum(e)) - 4.8) / 1.5, 4) as equivalent_single_magnitude from g""",
        "catalog", g="select *, pow(10, 1.5 * magnitude + 4.8) as e from catalog",
    ),
    "catalog_dedupe_last": duck(
        """select magnitude_type as source, place as event_id, strftime(event_time_utc, '%Y-%m-%d %H:%M:%S') as event_time_utc, round(magnitude, 4) as magnitude
from catalog qualify row_number() over (partition by magnitude_type, place order by cast(event_id as bigint) desc) = 1""",
        "catalog",
    ),
    "query_filter": duck(
        """select event_id, strftime(event_time_utc, '%Y-%m-%d %H:%M:%S') as time, round(latitude, 4) as latitude, round(longitude, 4) as longitude, round(magnitude, 4) as magnitude
from catalog where event_time_utc >= timestamp '2024-01-05' and event_time_utc < timestamp '2024-01-20'
  and latitude between 17.5 and 19 and longitude between -68 and -65 and magnitude >= 1""",
        "catalog",
    ),
    "catalog_quality": duck(
        """select count(*) as event_count, strftime(min(event_time_utc), '%Y-%m-%d %H:%M:%S') as first_event_time, strftime(max(event_time_utc), '%Y-%m-%d %H:%M:%S') as last_event_time,
  round(min(magnitude), 3) as minimum_magnitude, round(max(magnitude), 3) as maximum_magnitude, round(avg(magnitude), 3) as average_magnitude,
  count(*) - count(magnitude) as missing_magnitude_count, count(*) - count(depth_km) as missing_depth_count,
  count(event_id) - count(distinct event_id) as duplicate_event_count from catalog""",
        "catalog",
    ),
    "events_by_year": duck("select cast(year(time) as varchar) as year, count(*) as n from observed group by 1", "observed"),
    "geographic_centroid": duck(
        """select magnitude_type, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) as centroid_latitude, round(degrees(atan2(y, x)), 6) as centroid_longitude, event_count
from (select magnitude_type, sum(cos(radians(latitude)) * cos(radians(longitude))) as x, sum(cos(radians(latitude)) * sin(radians(longitude))) as y,
  sum(sin(radians(latitude))) as z, count(*) as event_count from catalog group by 1)""",
        "catalog",
    ),
    "seismic_moment": duck(
        "select event_id, case when magnitude_type = 'mww' then round(pow(10, 1.5 * magnitude + 9.1) / 1e18, 4) end as moment_1e18 from located", "located"
    ),
    "year_histogram": duck("select cast(year(time) as integer) as year, count(*) as n from observed group by 1", "observed"),
    "magnitude_histogram": duck(
        """select (case when magnitude >= 9 then 9.0 when magnitude >= 8.5 then 8.5 when magnitude >= 8 then 8.0 when magnitude >= 7.5 then 7.5
  when magnitude >= 7 then 7.0 when magnitude >= 6.5 then 6.5 else 6.0 end)::double as bin, count(*) as n from located where magnitude >= 6 group by 1""",
        "located",
    ),
    "topk_recent": duck(
        "select event_id, strftime(time, '%Y-%m-%d %H:%M:%S') as time, round(magnitude, 4) as magnitude from located order by located.time desc, event_id limit 10", "located"
    ),
    "largest_event": duck("select event_id, round(magnitude, 4) as magnitude from catalog order by catalog.magnitude desc nulls last, event_id limit 1", "catalog"),
}

# --- Revisions -------------------------------------------------------------------------------------------------------

_REVISED = {
    "base": "select event_id, 'us' as source, time, magnitude, time as updated_at, cast(event_id as bigint) as k from located",
    "old": "select * from base where k % 5 <> 0",
    "new": """select event_id, source, time, case when k % 2 = 0 then magnitude + 1 else magnitude end as magnitude,
  case when k % 2 = 0 then updated_at + interval 1 hour else updated_at end as updated_at, k from base where k % 3 = 0 or k % 5 = 0""",
    "merged": """select * from (select *, 1 as side from old union all select *, 2 as side from new)
qualify row_number() over (partition by source, event_id order by updated_at desc, time desc, side) = 1""",
}
ORACLES |= {
    "catalog_merge": duck(
        """select event_id, source, strftime(time, '%Y-%m-%d %H:%M:%S') as time, round(magnitude, 4) as magnitude,
  strftime(updated_at, '%Y-%m-%d %H:%M:%S') as updated_at from merged""",
        "located", **_REVISED,
    ),
    "merge_counts": duck(
        """select count(*) filter (o.event_id is null) as inserted,
  count(*) filter (o.event_id is not null and (o.magnitude, o.updated_at) is distinct from (m.magnitude, m.updated_at)) as updated,
  count(*) filter (o.event_id is not null and (o.magnitude, o.updated_at) is not distinct from (m.magnitude, m.updated_at)) as unchanged,
  count(*) as final_count from merged m left join old o using (source, event_id)""",
        "located", **_REVISED,
    ),
}

# --- Baselines -------------------------------------------------------------------------------------------------------

_STATS = {
    "mean_magnitude": "avg(magnitude)", "median_magnitude": "median(magnitude)", "maximum_magnitude": "max(magnitude)",
    "minimum_magnitude": "min(magnitude)", "mean_depth_km": "avg(depth)", "median_depth_km": "median(depth)",
    "minimum_depth_km": "min(depth)", "maximum_depth_km": "max(depth)",
    "total_energy_joules": "sum(pow(10, 1.5 * magnitude + 4.8)) / 1e9",
    "mean_energy_joules": "avg(pow(10, 1.5 * magnitude + 4.8)) / 1e9",
    "maximum_energy_joules": "max(pow(10, 1.5 * magnitude + 4.8)) / 1e9",
}
_COUNTS = {"event_count": "count(*)", "magnitude_event_count": "count(magnitude)", "depth_event_count": "count(depth)", "energy_event_count": "count(magnitude)"}
_UNIT = {"daily": "day", "weekly": "week", "monthly": "month"}


def _period_parts(period: str, source: str = "observed") -> dict[str, str]:
    unit = _UNIT[period]
    stats = ", ".join(f"{e} as {n}" for n, e in (_COUNTS | _STATS).items())
    shown = ", ".join([f"coalesce(g.{c}, 0) as {c}" for c in _COUNTS] + [f"g.{c}" for c in _STATS])
    return {
        "g": f"select date_trunc('{unit}', time)::timestamp as period_start, {stats} from {source} group by 1",
        "s": f"select unnest(generate_series(min(period_start), max(period_start), interval 1 {unit})) as period_start from g",
        "p": f"""select s.period_start, s.period_start + interval 1 {unit} as period_end, {shown},
  coalesce(g.event_count, 0) / cast(date_diff('day', s.period_start, s.period_start + interval 1 {unit}) as double) as event_rate_per_day,
  avg(coalesce(g.event_count, 0)) over (order by s.period_start rows between 6 preceding and current row) as rolling_event_count_mean
from s left join g using (period_start)""",
    }


def _periods(period: str) -> str:
    shown = [*_COUNTS] + [
        f"round({c}, {3 if c.endswith('_joules') else 12 if c.endswith('_magnitude') else 9}) as {c}" for c in (*_STATS, "event_rate_per_day", "rolling_event_count_mean")
    ]
    return duck(
        f"""select strftime(period_start, '%Y-%m-%d %H:%M:%S') as period_start, strftime(period_end, '%Y-%m-%d %H:%M:%S') as period_end,
  {", ".join(shown)} from p""",
        "observed", **_period_parts(period),
    )


_ALL = [*_COUNTS, "event_rate_per_day", *_STATS, "rolling_event_count_mean"]
_LONG = " union all ".join(f"select '{m}' as metric, cast({m} as double) as v from p" for m in _ALL)
_PRIMARY = ("event_count", "event_rate_per_day", "mean_magnitude", "maximum_magnitude", "mean_depth_km")
_COMPARED = {
    "past": "select * from observed where time < timestamp '2001-06-01'",
    **_period_parts("monthly", "past"),
    "h": " union all ".join(f"select '{m}' as metric, cast({m} as double) as v from p" for m in (*_PRIMARY, "total_energy_joules")),
    "now": "select * from observed where time >= timestamp '2001-06-01' and time < timestamp '2001-07-01'",
    "c": """select 'event_count' as metric, cast(count(*) as double) as x from now union all select 'event_rate_per_day', count(*) / 30.0::double from now
union all select 'mean_magnitude', avg(magnitude) from now union all select 'maximum_magnitude', max(magnitude) from now
union all select 'mean_depth_km', avg(depth) from now union all select 'total_energy_joules', sum(pow(10, 1.5 * magnitude + 4.8)) / 1e9 from now""",
    "k": """select h.metric, x, avg(v) as mean, quantile_cont(v, 0.1) as low, quantile_cont(v, 0.9) as high,
  100.0::double * count(*) filter (v <= x) / count(v) as rank from h join c using (metric) where v is not null group by h.metric, x""",
}
_WEIGHTS = "(values ('event_count', 0.30::double, false, 0), ('maximum_magnitude', 0.25::double, false, 1), ('total_energy_joules', 0.30::double, false, 2), ('mean_depth_km', 0.15::double, true, 3)) w(metric, weight, two_sided, pos)"
_LEVEL = "case when score is null then 'unavailable' when score >= 95 then 'extreme' when score >= 80 then 'elevated' when score >= 60 then 'noteworthy' else 'typical' end"
_RAW = "least(100, case when two_sided then 2 * abs(rank - 50) else greatest(0, 2 * (rank - 50)) end)"
ORACLES |= {
    **{f"baseline_{p}": _periods(p) for p in _UNIT},
    "baseline_distribution": duck(
        f"""select metric, count(v) as n, {_rounded({'mean': 'avg(v)', 'median': 'median(v)', 'standard_deviation': 'stddev_pop(v)', 'minimum': 'min(v)', 'maximum': 'max(v)', 'lower_percentile': 'quantile_cont(v, 0.1)', 'upper_percentile': 'quantile_cont(v, 0.9)'})}
from l group by 1""",
        "observed", **_period_parts("weekly"), l=_LONG,
    ),
    "current_comparison": duck(
        """select metric, round(case when metric = 'total_energy_joules' then x / 1e6 else x end, 6) as current_value,
  round(case when metric = 'total_energy_joules' then mean / 1e6 else mean end, 6) as mean, round(rank, 6) as percentile_rank,
  round(case when mean <> 0 then x / mean when x = 0 then 1.0::double end, 6) as ratio,
  case when x is null then 'unavailable' when x < low then 'below_historical_range' when x > high then 'above_historical_range' else 'within_historical_range' end as classification
from k""",
        "observed", **_COMPARED,
    ),
    "anomaly_scores": duck(
        f"""select '2001-06' as period, round(score, 6) as score, n as available_metric_count, {_LEVEL} as level, cast(4 as bigint) as configured_metric_count, best as strongest_metric
from (select sum(raw * weight) / sum(weight) as score, count(*) as n, arg_max(metric, raw * weight - pos / 1e9) as best
  from (select k.metric, weight, pos, {_RAW} as raw from k join {_WEIGHTS} using (metric) where x is not null))""",
        "observed", **_COMPARED,
    ),
}

# --- Time series: months with 12 months of lookback and at least 6 of coverage before ---------------------------------

_SERIES = {
    "g": f"""select date_trunc('month', time)::timestamp as period_start, count(*) as event_count, {", ".join(f"{_STATS[m]} as {m}" for m in ("mean_magnitude", "maximum_magnitude", "mean_depth_km", "total_energy_joules"))} from observed group by 1""",
    "cover": "select min(period_start) as a, max(period_start) as b from g",
    "cand": "select unnest(generate_series(a + interval 6 month, b, interval 1 month)) as c from cover",
    "back": "select c, c - interval 12 month as lo, unnest(generate_series(c - interval 12 month, c - interval 1 month, interval 1 month)) as q from cand",
    "placed": "select back.c, back.q, g.* from back left join g on g.period_start = back.q",
    "trimmed": """select *, min(case when period_start is not null then q end) over (partition by c) as first_q,
  max(case when period_start is not null then q end) over (partition by c) as last_q from placed""",
    "hist": """select c, q, coalesce(event_count, 0)::double as event_count,
  coalesce(event_count, 0) / cast(date_diff('day', q, q + interval 1 month) as double) as event_rate_per_day, mean_magnitude, maximum_magnitude, mean_depth_km, total_energy_joules
from trimmed where q between first_q and last_q""",
    "cur": "select c, coalesce(event_count, 0) as event_count, maximum_magnitude, mean_depth_km, total_energy_joules from cand left join g on g.period_start = cand.c",
    "ranks": " union all ".join(
        f"select h.c, '{m}' as metric, 100.0::double * count(*) filter (h.{m} <= u.{m}) / count(h.{m}) as rank from hist h join cur u using (c) where u.{m} is not null group by h.c having count(h.{m}) > 0"
        for m in ("event_count", "maximum_magnitude", "total_energy_joules", "mean_depth_km")
    ),
    "parts": f"select c, metric, weight, pos, {_RAW} as raw from ranks join {_WEIGHTS} using (metric)",
    "scores": "select c, sum(raw * weight) / sum(weight) as score, count(*) as n, arg_max(metric, raw * weight - pos / 1e9) as best from parts group by c",
    "pts": "select c as period_start, c + interval 1 month as period_end, round(score, 6) as score from scores",
    "num": """select *, row_number() over (order by period_start) as i, row_number() over (order by period_start desc) as r,
  sign(score - lag(score) over (order by period_start)) as step from pts""",
    "run": """select (select step from num where r = 1) as last_step,
  coalesce((select min(r) from num where step is distinct from (select step from num where r = 1)), (select count(*) + 1 from num)) - 1 as len""",
}
_MA = ", ".join(
    f"round(avg(score) over (order by period_start rows between {n - 1} preceding and current row), 9) as {name}_moving_average"
    for name, n in (("short", 7), ("medium", 14), ("long", 30))
)
_TREND_ROW = """select count(*) as available_count, (select score from num where r = 1) as latest_score, (select score from num where i = 1) as first_score,
  regr_slope(score, i) filter (r <= 7) as s1, regr_slope(score, i) filter (r between 8 and 14) as s2, avg(score) filter (r <= 7) as ma,
  (select case when coalesce(last_step, 0) > 0 then len else 0 end from run) as up, (select case when coalesce(last_step, 0) < 0 then len else 0 end from run) as down,
  (select score from num where r = least(30, (select max(r) from num))) as long_first from num"""
_PCT = "case when {a} = 0 then case when {b} = 0 then 0 end else ({b} - {a}) / abs({a}) * 100 end"
ORACLES |= {
    "time_series_points": duck(
        f"""select strftime(u.c, '%Y-%m-%d %H:%M:%S') as period_start, strftime(u.c + interval 1 month, '%Y-%m-%d %H:%M:%S') as period_end,
  strftime(u.c - interval 12 month, '%Y-%m-%d %H:%M:%S') as baseline_start,
  cast(least(12, date_diff('month', (select a from cover), u.c)) as bigint) as baseline_period_count, u.event_count,
  s.c is not null as is_available, round(score, 6) as score, case when s.c is not null then {_LEVEL} end as level, n as available_metric_count,
  case when s.c is null then 'empty_baseline_catalog' end as unavailable_reason
from cur u left join scores s on s.c = u.c""",
        "observed", **_SERIES,
    ),
    "trend_moving_averages": duck(
        f"select strftime(period_start, '%Y-%m-%d %H:%M:%S') as period_start, score, true as is_available, {_MA} from pts", "observed", **_SERIES
    ),
    "trend_summary": duck(
        f"""select available_count, round(latest_score, 4) as latest_score, round(s1, 4) as current_slope, round(s2, 4) as previous_slope, round(s1 - s2, 4) as acceleration,
  round(latest_score - ma, 4) as momentum, cast(up as bigint) as consecutive_increases, cast(down as bigint) as consecutive_decreases,
  (select round(score, 4) from pts order by score desc, period_start limit 1) as maximum_score,
  (select strftime(period_start, '%Y-%m-%d %H:%M:%S') from pts order by score desc, pts.period_start limit 1) as maximum_period_start,
  (select round(score, 4) from pts order by score, period_start limit 1) as minimum_score,
  (select strftime(period_start, '%Y-%m-%d %H:%M:%S') from pts order by score, pts.period_start limit 1) as minimum_period_start,
  round(pct, 4) as percent_change, direction,
  case when direction in ('insufficient_data') then direction when direction = 'stable' then 'weak'
    when points < 35 then 'weak' when points < 70 then 'moderate' else 'strong' end as strength,
  round(s1, 4) as short_slope, round({_PCT.format(a='long_first', b='latest_score')}, 4) as long_percent_change
from (select *, 50 * least(abs(s1) / 3, 1) + 30 * least((case when direction like '%increasing%' then up else down end) / 2.0, 1) + coalesce(20 * least(abs(pct) / 100, 1), 0) as points
  from (select *, {_PCT.format(a='first_score', b='latest_score')} as pct,
    case when available_count < 3 or s1 is null then 'insufficient_data' when s1 > 3 then 'rapidly_increasing' when s1 > 0.25 then 'increasing'
      when s1 >= -0.25 then 'stable' when s1 >= -3 then 'decreasing' else 'rapidly_decreasing' end as direction from ({_TREND_ROW})))""",
        "observed", **_SERIES,
    ),
}

# --- Pairs and contexts ----------------------------------------------------------------------------------------------

KM = "2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))"
_NEAR = {
    # Synthetic steps lie on parallels one degree long; the distance to a step is worked out from its ends as vectors.
    "ev": "select *, [cos(radians(latitude)) * cos(radians(longitude)), cos(radians(latitude)) * sin(radians(longitude)), sin(radians(latitude))] as p from located",
    "st": """select *, [cos(radians(start_latitude)) * cos(radians(start_longitude)), cos(radians(start_latitude)) * sin(radians(start_longitude)), sin(radians(start_latitude))] as a,
  [cos(radians(end_latitude)) * cos(radians(end_longitude)), cos(radians(end_latitude)) * sin(radians(end_longitude)), sin(radians(end_latitude))] as b from steps""",
    "cr": "select ev.*, st.* exclude (a, b), a, b, list_value(a[2]*b[3]-a[3]*b[2], a[3]*b[1]-a[1]*b[3], a[1]*b[2]-a[2]*b[1]) as n from ev, st",
    "ft": "select *, sqrt(list_dot_product(n, n)) as nn, list_dot_product(p, n) / sqrt(list_dot_product(n, n)) as lift from cr",
    "fl": "select *, list_value(p[1]-lift*n[1]/nn, p[2]-lift*n[2]/nn, p[3]-lift*n[3]/nn) as q from ft",
    "an": """select *, acos(greatest(-1, least(1, list_dot_product(a, b)))) as whole, acos(greatest(-1, least(1, list_dot_product(a, q) / sqrt(list_dot_product(q, q))))) as one,
  acos(greatest(-1, least(1, list_dot_product(q, b) / sqrt(list_dot_product(q, q))))) as two,
  2 * asin(sqrt(list_sum([pow(p[1]-a[1],2), pow(p[2]-a[2],2), pow(p[3]-a[3],2)])) / 2) as to_a, 2 * asin(sqrt(list_sum([pow(p[1]-b[1],2), pow(p[2]-b[2],2), pow(p[3]-b[3],2)])) / 2) as to_b from fl""",
    "ds": "select *, 6371.0088 * case when one + two - whole < 1e-7 then abs(asin(greatest(-1, least(1, lift)))) else least(to_a, to_b) end as km from an",
    "asc": "select * from ds where km <= 25 qualify row_number() over (partition by event_id order by round(km, 7), step_id) = 1",
}
_PAIR = """select l.event_id as source_event_id, r.event_id as target_event_id, l.time as source_time, r.time as target_time,
  (epoch_us(r.time) - epoch_us(l.time)) / 86400e6 as lag_days, {km} as distance_km, l.magnitude as source_magnitude, r.magnitude as target_magnitude,
  l.magnitude_type as source_magnitude_type, r.magnitude_type as target_magnitude_type, {ctx}
from x l join x r on r.time > l.time and epoch_us(r.time) - epoch_us(l.time) <= 5 * 86400e6 where {km} <= 60"""
_CTX = ("boundary_id", "left_plate", "right_plate", "boundary_class")
_STUDY = {
    **_NEAR,
    "x": "select s.event_id, s.time, s.magnitude, s.magnitude_type, s.latitude, s.longitude, a.boundary_id, a.left_plate, a.right_plate, a.boundary_class from strong s left join asc_ a using (event_id)".replace("asc_", "asc0"),
    "pr": _PAIR.format(
        km=KM.format(a="l", b="r"),
        ctx=", ".join([f"l.{c} as source_{c}, r.{c} as target_{c}" for c in _CTX])
        + ", least(l.left_plate, l.right_plate) = least(r.left_plate, r.right_plate) and greatest(l.left_plate, l.right_plate) = greatest(r.left_plate, r.right_plate) as same_plate_pair,"
        " l.boundary_id = r.boundary_id as same_boundary_id, l.boundary_class = r.boundary_class as same_boundary_class",
    ),
}
_STUDY = {("asc0" if k == "asc" else k): v for k, v in _STUDY.items()}
_WIN = {
    **_STUDY,
    "ends": """select source_event_id as e, true as post, lag_days, distance_km, coalesce(same_plate_pair, false) as sp, coalesce(same_boundary_id, false) as sb from pr
union all select target_event_id, false, lag_days, distance_km, coalesce(same_plate_pair, false), coalesce(same_boundary_id, false) from pr""",
    "wd": "select x.*, t.t, d.d from x, (values (1.0::double), (2.0::double), (5.0::double)) t(t), (values (20.0::double), (60.0::double)) d(d)",
    "ob": """select wd.event_id as source_event_id, any_value(wd.time) as source_time, any_value(magnitude) as source_magnitude, any_value(magnitude_type) as source_magnitude_type,
  any_value(boundary_id) as source_boundary_id, any_value(left_plate) as source_left_plate, any_value(right_plate) as source_right_plate, any_value(boundary_class) as source_boundary_class,
  t as time_window_days, d as distance_window_km,
  count(e) filter (not post) as pre_count_all, count(e) filter (post) as post_count_all,
  count(e) filter (sp and not post) as pre_count_same_plate_pair, count(e) filter (sp and post) as post_count_same_plate_pair,
  count(e) filter (sb and not post) as pre_count_same_boundary, count(e) filter (sb and post) as post_count_same_boundary
from wd left join ends on ends.e = wd.event_id and lag_days <= t and distance_km <= d group by wd.event_id, t, d""",
    "obs": """select *, epoch_us(source_time) / 86400e6 - time_window_days >= epoch_us(timestamp '2024-01-01') / 86400e6 as full_pre_window,
  epoch_us(source_time) / 86400e6 + time_window_days <= epoch_us(timestamp '2024-01-31') / 86400e6 as full_post_window, source_boundary_id is not null as source_has_plate_context from ob""",
    "eo": "select *, full_pre_window and full_post_window as edge_eligible from obs",
}


def _kind_totals(kind: str, use: str) -> str:
    change = f"(post_count_{kind} - pre_count_{kind})"
    return f"""cast(coalesce(sum(pre_count_{kind}) filter ({use}), 0) as bigint) as pre_{kind}_count, cast(coalesce(sum(post_count_{kind}) filter ({use}), 0) as bigint) as post_{kind}_count,
  round(avg({change}) filter ({use}), 4) as mean_post_minus_pre_{kind}, round(median({change}) filter ({use}), 4) as median_post_minus_pre_{kind},
  count(*) filter ({use} and {change} > 0) as source_post_gt_pre_{kind}_count, count(*) filter ({use} and {change} = 0) as source_post_eq_pre_{kind}_count,
  count(*) filter ({use} and {change} < 0) as source_post_lt_pre_{kind}_count"""


_RADIAL = ("all", "same_plate_pair", "same_boundary")
_PLACED = "edge_eligible and source_has_plate_context"
_DERIVED = ", ".join(
    f"post_{k}_count - pre_{k}_count as post_minus_pre_{k}, round(post_{k}_count / nullif(pre_{k}_count, 0)::double, 4) as post_pre_{k}_ratio" for k in _RADIAL
)
_CUM = f"""select threshold as source_minimum_magnitude, time_window_days, distance_window_km, count(*) filter (edge_eligible) as eligible_source_count,
  count(*) filter ({_PLACED}) as plate_context_source_count, {", ".join(_kind_totals(k, "edge_eligible" if k == "all" else _PLACED) for k in _RADIAL)}
from eo, (values (6.5::double), (7.0::double)) th(threshold) where source_magnitude >= threshold group by 1, 2, 3"""
_RING = "over (partition by source_minimum_magnitude, time_window_days order by distance_window_km)"


def _study(query: str, parts: dict[str, str]) -> str:
    return duck(query, "located", "strong", "steps", **parts)


ORACLES |= {
    "haversine_pairs": duck(
        f"select l.event_id as a, r.event_id as b, round({KM.format(a='l', b='r')}, 4) as distance_km from located l join located r on l.event_id < r.event_id where {KM.format(a='l', b='r')} <= 12",
        "located",
    ),
    "nearest_boundary": _study(
        f"select event_id, step_id, round(km, 4) as distance_km, {', '.join(_CTX)} from asc0", {k: v for k, v in _STUDY.items() if k not in ("x", "pr")}
    ),
    "interaction_pairs": _study(
        "select * exclude (source_time, target_time, lag_days, distance_km, source_magnitude, target_magnitude), strftime(source_time, '%Y-%m-%d %H:%M:%S') as source_time, strftime(target_time, '%Y-%m-%d %H:%M:%S') as target_time, "
        + _rounded({c: c for c in ("lag_days", "distance_km", "source_magnitude", "target_magnitude")})
        + " from pr",
        _STUDY,
    ),
    "interaction_windows": _study(
        "select * exclude (source_time, source_magnitude), strftime(source_time, '%Y-%m-%d %H:%M:%S') as source_time, round(source_magnitude, 4) as source_magnitude from eo", _WIN
    ),
    "interaction_cumulative": _study(f"select *, {_DERIVED} from cum", _WIN | {"cum": _CUM}),
    "interaction_annular": _study(
        f"select *, {_DERIVED} from ring",
        _WIN
        | {
            "cum": _CUM,
            "ring": "select source_minimum_magnitude, time_window_days, coalesce(lag(distance_window_km) "
            + _RING
            + ", 0) as lower_distance_km, distance_window_km as upper_distance_km, eligible_source_count, plate_context_source_count, "
            + ", ".join(f"{s}_{k}_count - coalesce(lag({s}_{k}_count) {_RING}, 0) as {s}_{k}_count" for k in _RADIAL for s in ("pre", "post"))
            + " from cum",
        },
    ),
    "major_pairs": _study(
        """select source_event_id, target_event_id, round(lag_days, 4) as lag_days, round(distance_km, 4) as distance_km from pr
where source_magnitude >= 8 or target_magnitude >= 8""",
        _STUDY,
    ),
    "network_summary": duck(
        """select (select count(distinct n) from nd) as node_count, (select count(*) from steps) as edge_count, (select count(distinct root) from rt) as component_count""",
        "steps",
        ed="select start_latitude || ',' || start_longitude as a, end_latitude || ',' || end_longitude as b from steps",
        nd="select a as n from ed union select b from ed",
        sy="select a, b from ed union select b, a from ed",
        rc="select n, n as m from nd union select rc.n, sy.b from rc join sy on sy.a = rc.m",
        rt="select n, min(m) as root from rc group by n",
    ),
    "event_search": duck(
        "select event_id, strftime(time, '%Y-%m-%d %H:%M:%S') as time, round(magnitude, 4) as magnitude, magnitude_type, round(latitude, 4) as latitude, round(longitude, 4) as longitude, round(depth, 4) as depth from located where magnitude >= 6.5 and event_id like '7%'",
        "located",
    ),
}

# --- Projections, faults, network and status --------------------------------------------------------------------------


def _nearest(p: str, segments: str, radius: float, events: str = "located") -> dict[str, str]:
    """Tables p_*: every event with every segment (sid, lat1, lon1, lat2, lon2) as vectors; p_best has the nearest."""

    def unit(lat: str, lon: str) -> str:
        return f"[cos(radians({lat})) * cos(radians({lon})), cos(radians({lat})) * sin(radians({lon})), sin(radians({lat}))]"

    return {
        f"{p}_v": f"""select e.event_id, s.*, {unit('e.latitude', 'e.longitude')} as p, {unit('lat1', 'lon1')} as a, {unit('lat2', 'lon2')} as b
from {events} e, ({segments}) s""",
        f"{p}_n": f"select *, list_value(a[2]*b[3]-a[3]*b[2], a[3]*b[1]-a[1]*b[3], a[1]*b[2]-a[2]*b[1]) as n from {p}_v",
        f"{p}_l": f"select *, sqrt(list_dot_product(n, n)) as nn, list_dot_product(p, n) / sqrt(list_dot_product(n, n)) as lift from {p}_n",
        f"{p}_q": f"select *, list_value(p[1]-lift*n[1]/nn, p[2]-lift*n[2]/nn, p[3]-lift*n[3]/nn) as q from {p}_l",
        f"{p}_c": f"""select *, 2 * asin(sqrt(list_sum([pow(a[1]-b[1],2), pow(a[2]-b[2],2), pow(a[3]-b[3],2)])) / 2) as whole,
  2 * asin(sqrt(list_sum([pow(p[1]-a[1],2), pow(p[2]-a[2],2), pow(p[3]-a[3],2)])) / 2) as to_a,
  2 * asin(sqrt(list_sum([pow(p[1]-b[1],2), pow(p[2]-b[2],2), pow(p[3]-b[3],2)])) / 2) as to_b,
  [q[1] / sqrt(list_dot_product(q, q)), q[2] / sqrt(list_dot_product(q, q)), q[3] / sqrt(list_dot_product(q, q))] as u from {p}_q""",
        f"{p}_d": f"""select *, 2 * asin(sqrt(list_sum([pow(u[1]-a[1],2), pow(u[2]-a[2],2), pow(u[3]-a[3],2)])) / 2) as one,
  2 * asin(sqrt(list_sum([pow(u[1]-b[1],2), pow(u[2]-b[2],2), pow(u[3]-b[3],2)])) / 2) as two from {p}_c""",
        f"{p}_k": f"""select *, one + two - whole < 1e-9 as inside,
  6371.0088 * case when one + two - whole < 1e-9 then abs(asin(greatest(-1, least(1, lift)))) else least(to_a, to_b) end as km from {p}_d""",
        f"{p}_best": f"select * from {p}_k where km <= {radius} qualify row_number() over (partition by event_id order by round(km, 7), sid) = 1",
    }


_STEP_SEGMENTS = "select step_id as sid, start_latitude as lat1, start_longitude as lon1, end_latitude as lat2, end_longitude as lon2 from steps"
_FAULT_SEGMENTS = """select 'fault-' || substring(step_id, 6, 9) as sid, start_latitude as lat1, start_longitude as lon1, start_latitude + 0.25 as lat2, start_longitude + 0.5 as lon2 from steps
union all select 'fault-' || substring(step_id, 6, 9), start_latitude + 0.25, start_longitude + 0.5, end_latitude, end_longitude from steps"""
_BY_STEP, _BY_FAULT = _nearest("st", _STEP_SEGMENTS, 25), _nearest("fa", _FAULT_SEGMENTS, 40)
_FRACTION = "case when inside then one / whole when to_a <= to_b then 0 else 1 end"
_NODE = "cast({c}_latitude as varchar) || ',' || cast({c}_longitude as varchar)"

ORACLES |= {
    "nearest_fault": _study("select event_id, sid as fault_id, round(km, 4) as distance_km from fa_best", _BY_FAULT),
    "boundary_projection": _study(
        f"""select event_id, step_id, boundary_id, left_plate, right_plate, boundary_class,
  round(case when inside then degrees(asin(u[3])) when to_a <= to_b then lat1 else lat2 end, 5) as projected_latitude,
  round(case when inside then degrees(atan2(u[2], u[1])) when to_a <= to_b then lon1 else lon2 end, 5) as projected_longitude,
  round({_FRACTION}, 5) as fraction, round({_FRACTION} * length_km, 5) as distance_from_start_km,
  round((1 - {_FRACTION}) * length_km, 5) as distance_to_end_km, round(km, 5) as distance_to_boundary_km
from st_best join steps on step_id = sid""",
        _BY_STEP,
    ),
    "dashboard_events": _study(
        """select s.event_id, strftime(s.time, '%Y-%m-%d %H:%M:%S') as time, round(s.magnitude, 4) as magnitude, s.magnitude_type, round(s.latitude, 4) as latitude,
  round(s.longitude, 4) as longitude, round(s.depth, 4) as depth, step_id, boundary_id, left_plate, right_plate, boundary_class,
  round(b.km, 4) as boundary_distance_km, f.sid as fault_id, round(f.km, 4) as fault_distance_km, coalesce(s.magnitude >= 7, false) as is_major
from located s left join st_best b using (event_id) left join steps on step_id = b.sid left join fa_best f using (event_id)""",
        _BY_STEP | _BY_FAULT,
    ),
    "dashboard_overview": _study(
        """select count(*) as event_count, count(*) filter (s.magnitude >= 7) as m7_count, count(*) filter (s.magnitude >= 8) as m8_count, count(*) filter (s.magnitude >= 9) as m9_count,
  cast(min(year(s.time)) as integer) as first_year, cast(max(year(s.time)) as integer) as last_year, round(100.0 * count(b.sid) / count(*), 1) as plate_coverage_percent, round(100.0 * count(f.sid) / count(*), 1) as fault_coverage_percent
from located s left join st_best b using (event_id) left join fa_best f using (event_id)""",
        _BY_STEP | _BY_FAULT,
    ),
    # Each plate pair's part of the synthetic network is a set of chains, so every path is the shortest one.
    "network_distance": duck(
        "select scope_key, n1, n2, min(km) as km from walk group by all",
        "steps",
        ed=f"""select least(left_plate, right_plate) || '|' || greatest(left_plate, right_plate) as scope_key,
  {_NODE.format(c='start')} as a, {_NODE.format(c='end')} as b, length_km from steps""",
        sy="select scope_key, a, b, length_km from ed union all select scope_key, b, a, length_km from ed",
        walk="""select distinct scope_key, a as n1, a as n2, cast(0 as double) as km, [a] as seen from sy
union all select w.scope_key, w.n1, sy.b, w.km + sy.length_km, list_append(w.seen, sy.b) from walk w join sy on sy.scope_key = w.scope_key and sy.a = w.n2 where not list_contains(w.seen, sy.b)""",
    ),
    "intelligence_index": duck(
        """select round(avg(score) filter (r <= 7), 1) as activity_index, count(*) filter (r <= 7) as index_period_count,
  case when count(*) filter (r <= 7) < 2 then 'insufficient_data' when abs(any_value(ch)) <= 5 then 'stable' when any_value(ch) > 0 then 'increasing' else 'decreasing' end as activity_trend,
  round(any_value(ch), 1) as activity_change, case when count(*) >= 30 and count(*) / any_value(total)::double >= 0.9 then 'high' when count(*) >= 7 then 'moderate' else 'low' end as confidence,
  round(100 * count(*) / any_value(total)::double * least(count(*) / 30.0::double, 1), 1) as confidence_score, count(*) as available_period_count,
  any_value(total) - count(*) as unavailable_period_count
from (select score, row_number() over (order by c desc) as r, (select count(*) from cand) as total,
  (select score from scores order by c desc limit 1) - (select score from (select score, row_number() over (order by c desc) as r from scores) where r = least(7, (select count(*) from scores))) as ch from scores)""",
        "observed", **_SERIES,
    ),
}

# --- Clusters, routes along the network, status -----------------------------------------------------------------------

_CLUSTERS = {
    "pt": "select cast(event_id as bigint) as position, time, latitude, longitude, depth, magnitude from located",
    # Equal coordinates are one weighted point.
    "sp": "select latitude, longitude, min(position) as a, count(*) as n from pt group by all",
    "nb": f"select l.a, r.a as b, r.n from sp l, sp r where {KM.format(a='l', b='r')} <= 10.8",
    "co": "select a from nb group by a having sum(n) >= 24",
    "rch": "select a as root, a as n from co union select rch.root, nb.b from rch join nb on nb.a = rch.n where nb.b in (select a from co)",
    "cm": "select n, min(root) as root from rch group by n",
    "nm": "select root, row_number() over (order by root) - 1 as cluster_id from (select distinct root from cm)",
    "ls": """select nb.a, coalesce(min(own.cluster_id), min(nm.cluster_id), -1) as cluster_id
from nb left join cm on cm.n = nb.b left join nm on nm.root = cm.root left join cm me on me.n = nb.a left join nm own on own.root = me.root group by nb.a""",
    "lb": "select pt.position, ls.cluster_id from pt join sp using (latitude, longitude) join ls using (a)",
    "mb": "select pt.*, cluster_id from pt join lb using (position) where cluster_id >= 0",
    "ce": """select cluster_id, degrees(atan2(z, sqrt(x * x + y * y))) as latitude, degrees(atan2(y, x)) as longitude, n from (select cluster_id, sum(cos(radians(latitude)) * cos(radians(longitude))) as x,
  sum(cos(radians(latitude)) * sin(radians(longitude))) as y, sum(sin(radians(latitude))) as z, count(*) as n from mb group by 1)""",
    "cs": f"""select mb.cluster_id, any_value(ce.latitude) as centroid_latitude, any_value(ce.longitude) as centroid_longitude, any_value(n) as event_count,
  max({KM.format(a='mb', b='ce')}) as radius_km, avg({KM.format(a='mb', b='ce')}) as mean_distance_km from mb join ce using (cluster_id) group by 1""",
}
_PROJECTED = {
    **_BY_STEP,
    "pj": f"""select event_id, step_id, boundary_id, left_plate, right_plate, boundary_class, least(left_plate, right_plate) || '|' || greatest(left_plate, right_plate) as pair,
  {_NODE.format(c='start')} as na, {_NODE.format(c='end')} as nb, {_FRACTION} * length_km as fs, (1 - {_FRACTION}) * length_km as te, km from st_best join steps on step_id = sid""",
    "ed": f"""select least(left_plate, right_plate) || '|' || greatest(left_plate, right_plate) as scope_key, {_NODE.format(c='start')} as a, {_NODE.format(c='end')} as b, length_km from steps""",
    "sy": "select scope_key, a, b, length_km from ed union all select scope_key, b, a, length_km from ed",
    "walk": """select distinct scope_key, a as n1, a as n2, cast(0 as double) as km, [a] as seen from sy
union all select w.scope_key, w.n1, sy.b, w.km + sy.length_km, list_append(w.seen, sy.b) from walk w join sy on sy.scope_key = w.scope_key and sy.a = w.n2 where not list_contains(w.seen, sy.b)""",
    "rp": f"""select l.event_id as l_id, r.event_id as r_id, l.time as lt, r.time as rt, l.magnitude as lm, r.magnitude as rm,
  (epoch_us(r.time) - epoch_us(l.time)) / 86400e6 as lag_days, {KM.format(a='l', b='r')} as radial from strong l join strong r on r.time > l.time and epoch_us(r.time) - epoch_us(l.time) <= 5 * 86400e6
where {KM.format(a='l', b='r')} <= 80""",
    "rt": """select l_id, r_id, min(s.off + walk.km + t.off) as around from rp
join (select event_id, pair, na as n, fs as off from pj union all select event_id, pair, nb, te from pj) s on s.event_id = l_id
join (select event_id, pair, na as n, fs as off from pj union all select event_id, pair, nb, te from pj) t on t.event_id = r_id and t.pair = s.pair
join walk on walk.scope_key = s.pair and walk.n1 = s.n and walk.n2 = t.n group by 1, 2""",
    "al": """select rp.*, s.step_id as ls, t.step_id as rs, s.boundary_id as lb, t.boundary_id as rb, s.left_plate as ll, s.right_plate as lr, t.left_plate as rl, t.right_plate as rr,
  s.boundary_class as lc, t.boundary_class as rc, s.pair = t.pair as same_pair,
  case when s.pair = t.pair then least(around, case when s.step_id = t.step_id then abs(s.fs - t.fs) end) end as along,
  case when s.step_id is null or t.step_id is null then 'missing_projection' when s.pair <> t.pair then 'different_plate_pair'
    when around is null and s.step_id <> t.step_id then 'disconnected_same_plate_pair_network' else 'available' end as status
from rp left join pj s on s.event_id = l_id left join pj t on t.event_id = r_id left join rt using (l_id, r_id)""",
}
_ALONG_WINDOWS = {
    **_PROJECTED,
    "en": """select l_id as e, true as post, lag_days, along, radial from al where status = 'available' and least(along, radial) <= 60
union all select r_id, false, lag_days, along, radial from al where status = 'available' and least(along, radial) <= 60""",
    "wd": """select s.event_id as source_event_id, s.time as source_time, s.magnitude as source_magnitude, s.magnitude_type as source_magnitude_type, step_id as source_step_id, boundary_id as source_boundary_id,
  left_plate as source_left_plate, right_plate as source_right_plate, boundary_class as source_boundary_class, km as source_distance_to_boundary_km, t.t as time_window_days, d.d as distance_window_km
from strong s join pj using (event_id), (values (1.0::double), (2.0::double), (5.0::double)) t(t), (values (20.0::double), (60.0::double)) d(d)""",
    "ow": f"""select wd.*, {", ".join(f"(select count(*) from en where en.e = wd.source_event_id and {'' if side == 'post' else 'not '}post and lag_days <= time_window_days and {m} <= distance_window_km) as {side}_count_{k}" for k, m in (("along_boundary", "along"), ("routed_radial", "radial")) for side in ("pre", "post"))},
  epoch_us(source_time) / 86400e6 - time_window_days >= epoch_us(timestamp '2024-01-01') / 86400e6 as full_pre_window,
  epoch_us(source_time) / 86400e6 + time_window_days <= epoch_us(timestamp '2024-01-31') / 86400e6 as full_post_window from wd""",
    "eo": "select *, full_pre_window and full_post_window as edge_eligible from ow",
    "cum": f"""select threshold as source_minimum_magnitude, time_window_days, distance_window_km, count(*) filter (edge_eligible) as eligible_source_count,
  {", ".join(_kind_totals(k, "edge_eligible") for k in ("along_boundary", "routed_radial"))}
from eo, (values (6.5::double), (7.0::double)) th(threshold) where source_magnitude >= threshold group by 1, 2, 3""",
}
_ALONG_DERIVED = ", ".join(
    f"post_{k}_count - pre_{k}_count as post_minus_pre_{k}, round(post_{k}_count / nullif(pre_{k}_count, 0)::double, 4) as post_pre_{k}_ratio" for k in ("along_boundary", "routed_radial")
)
_STATUS = "case when {r} is null then 'unavailable' when {r} < {a} then 'very_quiet' when {r} < {b} then 'quiet' when {r} <= {c} then 'normal' when {r} <= {d} then 'elevated' else 'exceptional' end"
ORACLES |= {
    "dbscan_labels": duck("select position, cluster_id from lb", "located", **_CLUSTERS),
    "dbscan_clusters": duck(
        """select cluster_id, event_count, round(centroid_latitude, 4) as centroid_latitude, round(centroid_longitude, 4) as centroid_longitude, round(radius_km, 4) as radius_km,
  round(mean_distance_km, 4) as mean_distance_km, cast(event_count as integer) as member_indices from cs""",
        "located", **_CLUSTERS,
    ),
    "along_pairs": _study(
        """select l_id as earlier_event_id, r_id as later_event_id, strftime(lt, '%Y-%m-%d %H:%M:%S') as earlier_time, strftime(al.rt, '%Y-%m-%d %H:%M:%S') as later_time, round(lm, 4) as earlier_magnitude, round(rm, 4) as later_magnitude,
  ls as earlier_step_id, rs as later_step_id, lb as earlier_boundary_id, rb as later_boundary_id, ll as earlier_left_plate, lr as earlier_right_plate, rl as later_left_plate, rr as later_right_plate,
  lc as earlier_boundary_class, rc as later_boundary_class, round(lag_days, 4) as lag_days, round(radial, 4) as radial_distance_km, status as route_status, same_pair as same_plate_pair,
  lb = rb as same_boundary_id, round(along, 4) as along_boundary_distance_km, coalesce(along <= 60, false) as within_along_boundary_limit from al""",
        _PROJECTED,
    ),
    "route_coverage": _study(
        """select count(*) as candidate_pair_count, count(*) filter (status = 'available') as route_available_pair_count, count(*) filter (along <= 60) as within_along_boundary_limit_pair_count,
  count(*) filter (status = 'missing_projection') as missing_projection_pair_count, count(*) filter (status = 'different_plate_pair') as different_plate_pair_count,
  count(*) filter (status = 'disconnected_same_plate_pair_network') as disconnected_same_plate_pair_count, round(median(along), 4) as median_along_boundary_distance_km,
  round(median(along / radial) filter (radial > 0), 4) as median_along_to_radial_ratio from al""",
        _PROJECTED,
    ),
    "along_windows": _study(
        """select * exclude (source_time, source_magnitude, source_distance_to_boundary_km), strftime(source_time, '%Y-%m-%d %H:%M:%S') as source_time, round(source_magnitude, 4) as source_magnitude,
  round(source_distance_to_boundary_km, 4) as source_distance_to_boundary_km from eo""",
        _ALONG_WINDOWS,
    ),
    "along_statistics": _study(f"select *, {_ALONG_DERIVED} from cum", _ALONG_WINDOWS),
    "along_annular": _study(
        f"select *, {_ALONG_DERIVED} from ring",
        _ALONG_WINDOWS
        | {
            "ring": "select source_minimum_magnitude, time_window_days, coalesce(lag(distance_window_km) "
            + _RING
            + ", 0) as lower_distance_km, distance_window_km as upper_distance_km, eligible_source_count, "
            + ", ".join(f"{s}_{k}_count - coalesce(lag({s}_{k}_count) {_RING}, 0) as {s}_{k}_count" for k in ("along_boundary", "routed_radial") for s in ("pre", "post"))
            + " from cum"
        },
    ),
    "ratio_correlation": _study(
        """select round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 4) as correlation, count(*) as n
from (select post_along_boundary_count / nullif(pre_along_boundary_count, 0)::double as a, post_routed_radial_count / nullif(pre_routed_radial_count, 0)::double as b from cum) where a is not null and b is not null""",
        _ALONG_WINDOWS,
    ),
    "latest_status": duck(
        f"""select {_STATUS.format(r='act', a=0.5, b=0.8, c=1.2, d=1.75)} as activity_status, {_STATUS.format(r='ene', a=0.4, b=0.75, c=1.35, d=2.5)} as energy_status,
  case when dep is null then 'unavailable' when abs(dep) <= 5 then 'normal' when abs(dep) <= 15 then 'elevated' else 'exceptional' end as depth_status,
  case when days - 7 < 30 then 'Very Low' when days - 7 < 180 then 'Low' when days - 7 < 730 then 'Moderate' else 'High' end as confidence,
  ['unavailable', 'very_quiet', 'quiet', 'normal', 'elevated', 'exceptional'][greatest(list_position(o, activity_status), list_position(o, energy_status), list_position(o, depth_status))] as overall_status,
  printf('%+.1f%%', (act - 1) * 100) as activity_change, cast(n7 as bigint) as event_count_7d, cast(total as bigint) as total_events, cast(total as bigint) as event_count
from (select round_even(avg(event_count) over w7 / avg(event_count) over wb, 4) as act, avg(e) over w7 / avg(e) over wb as ene, round_even(avg(d) over w7 - avg(d) over wb, 4) as dep,
    sum(event_count) over w7 as n7, count(*) over () as days, sum(event_count) over () as total, ['unavailable', 'very_quiet', 'quiet', 'normal', 'elevated', 'exceptional'] as o, date
  from (select {_DAY}, coalesce(sum(pow(10, 1.5 * magnitude + 4.8)), 0) as e, round_even(avg(depth_km), 3) as d from catalog group by 1)
  window w7 as ({_LAST[7]}), wb as ({_BEFORE})) order by date desc limit 1""",
        "catalog",
    ),
}

_HALVES = {
    **_CLUSTERS,
    # Swarms are made of complete events.
    "pt": _CLUSTERS["pt"] + " where magnitude is not null",
    "sq": """select mb.*, row_number() over (partition by cluster_id order by time, position) <= floor(count(*) over (partition by cluster_id) / 2) as early,
  (epoch_us(time) - epoch_us(min(time) over (partition by cluster_id))) / 86400e6 as days from mb""",
    "hv": """select cluster_id, early, degrees(atan2(z, sqrt(x * x + y * y))) as latitude, degrees(atan2(y, x)) as longitude from (select cluster_id, early, sum(cos(radians(latitude)) * cos(radians(longitude))) as x,
  sum(cos(radians(latitude)) * sin(radians(longitude))) as y, sum(sin(radians(latitude))) as z from sq group by 1, 2)""",
    "mv": f"""select e.cluster_id, {KM.format(a='e', b='l')} as km, fmod(degrees(atan2(sin(radians(l.longitude - e.longitude)) * cos(radians(l.latitude)),
  cos(radians(e.latitude)) * sin(radians(l.latitude)) - sin(radians(e.latitude)) * cos(radians(l.latitude)) * cos(radians(l.longitude - e.longitude)))) + 360, 360) as turn
from hv e join hv l using (cluster_id) where e.early and not l.early""",
    "sw": """select cluster_id, min(time) as start_time, max(time) as end_time, max(days) as duration_days, avg(magnitude) as mean_magnitude, avg(depth) as mean_depth_km, regr_slope(magnitude, days) as magnitude_slope,
  regr_slope(depth, days) as depth_slope, count(*) filter (epoch_us(time) >= (select epoch_us(max(time)) from pt) - 7 * 86400e6) as recent_event_count, count(*) as n,
  ((select epoch_us(max(time)) from pt) - epoch_us(max(time))) / 86400e6 as age, 'swarm-' || substring(sha256(string_agg(cast(position as varchar), chr(31) order by cast(position as varchar))), 1, 12) as swarm_id from sq group by 1""",
}
ORACLES["swarm_summary"] = duck(
    """select cluster_id, swarm_id, event_count, strftime(start_time, '%Y-%m-%d %H:%M:%S') as start_time, strftime(end_time, '%Y-%m-%d %H:%M:%S') as end_time,
  round(duration_days, 4) as duration_days, round(n / case when duration_days > 0 then duration_days else 1 end, 4) as event_rate_per_day,
  round(case when radius_km > 0 then n / (pi() * radius_km * radius_km) end, 4) as spatial_density_events_per_sq_km, round(centroid_latitude, 4) as centroid_latitude,
  round(centroid_longitude, 4) as centroid_longitude, round(radius_km, 4) as radius_km, round(mean_distance_km, 4) as mean_distance_km, round(mean_magnitude, 4) as mean_magnitude,
  round(mean_depth_km, 4) as mean_depth_km, round(magnitude_slope, 4) as magnitude_slope, round(depth_slope, 4) as depth_slope,
  case when magnitude_slope > 0 then 'increasing' when magnitude_slope < 0 then 'decreasing' else 'stable' end as magnitude_trend,
  case when depth_slope > 0 then 'increasing' when depth_slope < 0 then 'decreasing' else 'stable' end as depth_trend,
  recent_event_count, round(km, 4) as migration_km, round(case when km > 1 then turn end, 4) as migration_bearing,
  case when km > 1 then ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][cast(round_even(turn / 45, 0) as integer) % 8 + 1] else 'stationary' end as migration_direction,
  case when age <= 1 then 'active' when age <= 7 then 'recently_active' else 'inactive' end as activity_status
from sw join cs using (cluster_id) join mv using (cluster_id)""",
    "located", **_HALVES,
)

_RATIOS = ", ".join(f"round(post_{k}_count / nullif(pre_{k}_count, 0)::double, 4) as post_pre_{k}_ratio" for k in ("along_boundary", "routed_radial"))
ORACLES |= {
    "nearest_fault_scan": ORACLES["nearest_fault"],
    "checked_projections": ORACLES["boundary_projection"],
    "distance_matrix": duck(
        f"select l.step_id as i, r.step_id as j, case when l.step_id = r.step_id then 0 else round({KM.format(a='l', b='r')}, 4) end as distance_km from p l, p r",
        "steps",
        p="select step_id, start_latitude as latitude, start_longitude as longitude from steps",
    ),
    "decay_series": _study(
        f"select time_window_days, {_RATIOS} from cum where source_minimum_magnitude = 6.5 and distance_window_km = 60", _ALONG_WINDOWS
    ),
    "study_cells": _study(
        f"""select * from (select source_minimum_magnitude, time_window_days, distance_window_km, {_RATIOS} from cum)
where post_pre_along_boundary_ratio is not null and post_pre_routed_radial_ratio is not null""",
        _ALONG_WINDOWS,
    ),
    "annular_series": f"""select lower_distance_km, upper_distance_km, post_pre_along_boundary_ratio, post_pre_routed_radial_ratio
from ({ORACLES['along_annular']}) a where source_minimum_magnitude = 6.5 and time_window_days = 2""",
}
