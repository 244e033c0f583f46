"""Vector, score and identity expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Similarity within [0, 1]; 0.5 where a vector is missing."""
    value = dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-8)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), F.lit(0.5))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def spread(n: Column) -> Column:
    """Attenuation of an entity linked to n memories."""
    return 1 / (1 + 0.001 * F.pow((n - 1).cast("double"), 2))


def nugget(x: Column) -> Column:
    """A nugget's score as 0, 0.5 or 1."""
    return F.when(x >= 0.75, 1.0).when(x >= 0.25, 0.5).otherwise(0.0)


def normalized_bm25(raw: Column, midpoint: float = 5.0, steepness: float = 0.7) -> Column:
    return 1 / (1 + F.exp(-steepness * (raw - midpoint)))


def bm25_parameters(terms: Column) -> tuple[Column, Column]:
    """(midpoint, steepness) for a query of so many terms: longer queries reach larger sums."""
    extra = F.greatest(terms - 3, F.lit(0))
    return 5.0 + 1.0 * extra, 0.7 / (1 + 0.1 * extra)


def decay(age_days: Column, strategy: str = "exponential", half_life: float = 30.0, most: float = 365.0) -> Column:
    if strategy == "exponential":
        return F.pow(F.lit(0.5), age_days / half_life)
    return F.greatest(F.lit(0.1), 1 - age_days / most) if strategy == "linear" else F.lit(1.0)


def freshness(age_days: Column, days: float = 1.0, factor: float = 1.2) -> Column:
    return F.when(age_days < days, factor).otherwise(1.0)


def fused(vector: Column, bm25: Column, graph: Column, entity: Column, factor: Column | float = 1.0) -> Column:
    """Sum of the signals over what the active ones can reach, at most 1, decayed."""
    active = 1.0 + F.when(bm25 > 0, 1.0).otherwise(0.0) + F.when(graph > 0, 0.5).otherwise(0.0) + F.when(entity > 0, 0.5).otherwise(0.0)
    return F.least(F.lit(1.0), (vector + bm25 + graph + entity) / active) * factor


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The version-5 UUID of a name, as the standard defines it."""
    h = F.sha1(F.concat(F.lit(bytearray(namespace.bytes)), name.cast("binary")))
    digit = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.element_at(F.array(*map(F.lit, "89ab")), digit % 4 + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def content_id(*parts: Column) -> Column:
    """A deterministic id from the content."""
    return F.md5(F.concat_ws("\x1f", *parts))
