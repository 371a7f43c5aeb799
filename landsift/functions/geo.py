"""Geometry as columns: great-circle distance, grid cells, point in polygon."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_000.0  # fixed value


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between two points in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH_METRES) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def floor_div(x: Column, step: float) -> Column:
    """Floor of x / step by way of the remainder, exact where x is a decimal multiple of step."""
    m = F.pmod(x, F.lit(step))
    d = (x - m) / step
    return (F.floor(d) + F.when(d - F.floor(d) > 0.5, 1).otherwise(0)).cast("long")


def on_segment(lat: Column, lng: Column, a: Column, b: Column) -> Column:
    """Exactly on the segment a-b, no tolerance."""
    cross = (b["lng"] - a["lng"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lng - a["lng"])
    return (
        (cross == 0)
        & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))
        & lng.between(F.least(a["lng"], b["lng"]), F.greatest(a["lng"], b["lng"]))
    )


def crosses(lat: Column, lng: Column, a: Column, b: Column) -> Column:
    """A ray towards greater lng crosses the edge a-b."""
    straddles = (a["lat"] > lat) != (b["lat"] > lat)
    return F.when(straddles, lng < (b["lng"] - a["lng"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lng"]).otherwise(F.lit(False))


def point_in_polygon(lat: Column, lng: Column, ring: Column) -> Column:
    """Inside or on the border of an implicitly closed ring of (lat, lng); rings of under 3 points hold nothing."""
    edges = F.arrays_zip(ring.alias("a"), F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)).alias("b"))
    odd = F.aggregate(edges, F.lit(False), lambda acc, e: acc != crosses(lat, lng, e["a"], e["b"]))
    border = F.exists(edges, lambda e: on_segment(lat, lng, e["a"], e["b"]))
    return F.when(F.size(ring) < 3, F.lit(False)).otherwise(border | odd)
