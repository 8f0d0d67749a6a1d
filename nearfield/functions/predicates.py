"""Filter trees over point fields, composed into one boolean column.

Leaves stay plain comparisons, so they reach the Parquet scan as pushed filters.
Only a negation has to say what a missing field means: it does not match.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mean radius in metres.
EARTH_RADIUS = 6_371_008.8


def field(points: DataFrame, name: str) -> Column:
    """A column of the table, or else the payload value of that name."""
    if name in points.columns:
        return F.col(f"`{name}`")
    return F.try_element_at("payload", F.lit(name))


def number(value: Column) -> Column:
    """Payload text as a number; null, hence no match, where it is none."""
    return value.try_cast("double")


def match(value: Column, wanted: Any) -> Column:
    """Equality; a number is compared with text as a number, and matches no other text."""
    if isinstance(wanted, bool) or not isinstance(wanted, (int, float)):
        return value == F.lit(wanted)
    return value.try_cast("decimal(38,9)" if isinstance(wanted, int) else "double") == F.lit(wanted)


def match_any(value: Column, wanted: list[Any]) -> Column:
    return value.isin(wanted)


def in_range(
    value: Column,
    gt: float | None = None,
    gte: float | None = None,
    lt: float | None = None,
    lte: float | None = None,
) -> Column:
    """Bounds on a number. Payload values are text: pass them through ``number``."""
    tests = []
    if gt is not None:
        tests.append(value > gt)
    if gte is not None:
        tests.append(value >= gte)
    if lt is not None:
        tests.append(value < lt)
    if lte is not None:
        tests.append(value <= lte)
    return must(*tests)


def place(value: Column) -> Column:
    """Payload text, a JSON object with lon and lat, as a place; null where it is none."""
    return F.from_json(value, "lon double, lat double")


def in_box(place: Column, west: float, south: float, east: float, north: float) -> Column:
    """Places in a box in degrees, its edges included; one whose west exceeds its east spans the date line."""
    lon = place["lon"]
    across = (lon >= west) | (lon <= east) if west > east else lon.between(west, east)
    return place["lat"].between(south, north) & across


def in_radius(place: Column, lon: float, lat: float, metres: float) -> Column:
    """Places at most so far from a centre, on a sphere."""
    rise, turn = F.radians(place["lat"] - lat) / 2, F.radians(place["lon"] - lon) / 2
    chord = F.sin(rise) ** 2 + F.cos(F.radians(F.lit(lat))) * F.cos(F.radians(place["lat"])) * F.sin(turn) ** 2
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(chord, F.lit(1.0)))) <= metres


def must(*conditions: Column) -> Column:
    return reduce(and_, conditions, F.lit(True))


def should(*conditions: Column) -> Column:
    """At least one holds; an empty list asks for nothing."""
    return reduce(or_, conditions) if conditions else F.lit(True)


def must_not(*conditions: Column) -> Column:
    return must(*[~F.coalesce(c, F.lit(False)) for c in conditions])
