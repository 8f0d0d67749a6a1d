"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The distances a collection may use.
DISTANCES = ("Cosine", "Euclid", "Dot")

# Scores are compared after rounding, so that the order does not hang on the last bit.
SCORE_DIGITS = 6


def check_distance(name: str) -> str:
    if name not in DISTANCES:
        raise ValueError(f"distance {name!r}: must be one of {', '.join(DISTANCES)}")
    return name


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; null when the sizes differ or an element is null."""
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclid(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return norm(diff)


def score(a: Column, b: Column, distance: str = "Cosine") -> Column:
    by_name = {"Cosine": cosine, "Euclid": euclid, "Dot": dot}
    return F.round(by_name[check_distance(distance)](a, b), SCORE_DIGITS)


def l2_normalise(a: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    length = norm(a)
    return F.transform(
        a, lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0))
    )
