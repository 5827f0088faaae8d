"""Schemas of catalogs at rest and the columns that sinks write."""

from __future__ import annotations

CATALOG = (
    "event_id string, time timestamp, latitude double, longitude double, depth double, magnitude double, "
    "magnitude_type string, place string, status string, event_type string, source string, updated_at timestamp"
)
PROVIDER = (
    "event_id string, source string, event_time_utc timestamp, updated_time_utc timestamp, latitude double, "
    "longitude double, depth_km double, magnitude double, magnitude_type string, place string, event_type string, "
    "status string, tsunami_flag boolean, felt_reports bigint, significance bigint, alert_level string, "
    "detail_url string, source_url string"
)
CATALOG_COLUMNS = tuple(part.split()[0] for part in CATALOG.split(", "))
EXPORT_COLUMNS = tuple("updated_time" if c == "updated_at" else c for c in CATALOG_COLUMNS if c != "status")
OBSERVATORY = {
    "event_id": "event_id", "event_time_utc": "time", "latitude": "latitude", "longitude": "longitude",
    "depth_km": "depth", "magnitude": "magnitude", "place": "place", "source": "source", "updated_time_utc": "updated_at",
}
GEOJSON = (
    "type string, features array<struct<id:string, geometry:struct<type:string, coordinates:array<double>>, "
    "properties:map<string,string>>>"
)
STEP_FIELDS = (
    "sequence", "boundary_id", "start_longitude", "start_latitude", "end_longitude", "end_latitude", "length_km",
    "azimuth", "velocity", "velocity_azimuth", "divergence", "strike_slip", "elevation", "age", "boundary_class",
)
