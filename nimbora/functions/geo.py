"""Distances on the globe, scores and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nimbora.config import Climate


def haversine_mi(lat1, lon1, lat2, lon2, c: Climate = Climate()) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    return F.lit(2 * c.earth_mi) * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def distance_score(miles: Column, c: Climate = Climate()) -> Column:
    """Full marks within the radius, then an exponential decay, rounded half to even."""
    far = F.rint(c.max_score * F.exp(-(miles - c.score_radius_mi) / c.score_scale_mi)).cast("int")
    return F.when(miles <= c.score_radius_mi, F.lit(c.max_score)).otherwise(far)


def band(pct: Column, *phrases: str, cuts: tuple = (15, 35, 65, 85)) -> Column:
    out = F.when(pct < cuts[0], phrases[0])
    for cut, phrase in zip(cuts[1:], phrases[1:], strict=False):
        out = out.when(pct < cut, phrase)
    return out.otherwise(phrases[len(cuts)])


def color_scale(v: Column, low: Column, high: Column) -> Column:
    """(v - low) / (high - low), clipped to 0..1; a width of 0 counts as 1."""
    width = F.when(high == low, 1.0).otherwise(high - low)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / width))
