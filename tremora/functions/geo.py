"""Column functions on the sphere. Angles are degrees outside, radians inside; distances are kilometres."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
CARDINALS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
#: Below this an angle or a vector counts as zero.
TINY = 1e-9


def _between(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    a, b, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(turn) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def cardinal(degrees: Column) -> Column:
    """One of eight directions; halves go to the even sector."""
    sector = F.pmod(F.rint(degrees / 45).cast("int"), F.lit(8))
    return F.element_at(F.array(*(F.lit(c) for c in CARDINALS)), sector + 1)


@dataclass(frozen=True)
class Vector:
    """Three columns."""

    x: Column
    y: Column
    z: Column

    @classmethod
    def at(cls, lat: Column, lon: Column) -> Vector:
        a, b = F.radians(lat), F.radians(lon)
        return cls(F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))

    def dot(self, other: Vector) -> Column:
        return self.x * other.x + self.y * other.y + self.z * other.z

    def cross(self, other: Vector) -> Vector:
        return Vector(
            self.y * other.z - self.z * other.y, self.z * other.x - self.x * other.z, self.x * other.y - self.y * other.x
        )

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def minus(self, other: Vector) -> Vector:
        return Vector(self.x - other.x, self.y - other.y, self.z - other.z)

    def times(self, k: Column) -> Vector:
        return Vector(self.x * k, self.y * k, self.z * k)

    def angle(self, other: Vector) -> Column:
        """Stable for small and for nearly opposite vectors."""
        return F.atan2(self.cross(other).norm(), self.dot(other))

    def lat(self) -> Column:
        return F.degrees(F.atan2(self.z, F.hypot(self.x, self.y)))

    def lon(self) -> Column:
        return F.degrees(F.atan2(self.y, self.x))


def segment_km(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance to a great-circle segment: across the track where the foot lies on it, else to the nearer end.

    A segment of no length is a point.
    """
    d13 = haversine_km(lat1, lon1, lat, lon) / EARTH_KM
    d12 = haversine_km(lat1, lon1, lat2, lon2) / EARTH_KM
    turn = F.radians(bearing(lat1, lon1, lat, lon) - bearing(lat1, lon1, lat2, lon2))
    across = F.asin(_between(F.sin(d13) * F.sin(turn), -1.0, 1.0))
    along = F.atan2(F.sin(d13) * F.cos(turn), F.cos(d13))
    ends = F.least(haversine_km(lat1, lon1, lat, lon), haversine_km(lat2, lon2, lat, lon))
    return F.when(d12 == 0, d13 * EARTH_KM).when((along >= 0) & (along <= d12), F.abs(across) * EARTH_KM).otherwise(ends)


def with_arc_foot(df: DataFrame, lat: str, lon: str, lat1: str, lon1: str, lat2: str, lon2: str) -> DataFrame:
    """df with where a point falls on a minor arc: foot_latitude, foot_longitude, foot_fraction (the share of the arc
    from its start) and foot_km (distance to it). Beyond the arc that is its nearer end, the start if both are as near.

    Built in steps, so that no vector is spelled out more than once in the plan.
    """
    def vector(name: str) -> Vector:
        return Vector(F.col(f"{name}.x"), F.col(f"{name}.y"), F.col(f"{name}.z"))

    def kept(v: Vector) -> Column:
        return F.struct(v.x.alias("x"), v.y.alias("y"), v.z.alias("z"))

    def share(a: Column, b: Column) -> Column:
        return a / F.greatest(b, F.lit(1e-300))

    c = F.col
    step = df.withColumns(
        {
            "__point": kept(Vector.at(c(lat), c(lon))),
            "__start": kept(Vector.at(c(lat1), c(lon1))),
            "__end": kept(Vector.at(c(lat2), c(lon2))),
        }
    )
    point, start, end, pole, foot = (vector(f"__{n}") for n in ("point", "start", "end", "pole", "foot"))
    step = step.withColumn("__pole", kept(start.cross(end))).withColumn("__size", pole.norm())
    step = step.withColumn("__lift", share(share(point.dot(pole), c("__size")), c("__size")))
    step = step.withColumn("__flat", kept(point.minus(pole.times(c("__lift"))))).withColumn("__length", vector("__flat").norm())
    step = step.withColumn("__foot", kept(vector("__flat").times(share(F.lit(1.0), c("__length")))))
    step = step.withColumns({"__whole": start.angle(end), "__first": start.angle(foot), "__second": foot.angle(end)})
    on = (c("__size") > TINY) & (c("__length") > TINY) & (F.abs(c("__first") + c("__second") - c("__whole")) <= TINY)
    step = step.withColumns({"__on": on, "__near_start": point.angle(start) <= point.angle(end)})

    def pick(inside: Column, at_start: Column, at_end: Column) -> Column:
        return F.when(c("__on"), inside).when(c("__near_start"), at_start).otherwise(at_end)

    step = step.withColumns(
        {
            "foot_latitude": pick(foot.lat(), c(lat1), c(lat2)),
            "foot_longitude": pick(foot.lon(), c(lon1), c(lon2)),
            "foot_fraction": pick(_between(share(c("__first"), c("__whole")), 0.0, 1.0), F.lit(0.0), F.lit(1.0)),
            "foot_km": pick(point.angle(foot), point.angle(start), point.angle(end)) * EARTH_KM,
        }
    )
    return step.drop(*(x for x in step.columns if x.startswith("__")))
