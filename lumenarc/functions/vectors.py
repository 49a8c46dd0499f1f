"""Vectors and perceptual hashes as columns, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where it stands inside a function over elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """PRJ-15: unit length; a zero vector stays zero."""
    return let(F.struct(v.alias("v"), norm(v).alias("n")), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]))


def cosine(a: Column, b: Column) -> Column:
    """PRJ-15: 0 where a vector is zero."""
    return let(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0)))


def blend_vector(query: Column, aux: Column, weight: float = 0.75) -> Column:
    """PRJ-16: normalise(weight * normalise(query) + (1 - weight) * normalise(aux))."""
    mixed = F.zip_with(l2_normalise(query), l2_normalise(aux), lambda x, y: x * weight + y * (1 - weight))
    return let(mixed, l2_normalise)


def sign_hash(v: Column, bits: int = 64) -> Column:
    """Hex of the sign bits of the first ``bits`` elements."""
    digits = [
        F.lower(F.hex(sum((F.when(F.get(v, F.lit(4 * k + j)) > 0, 8 >> j).otherwise(0) for j in range(4)), F.lit(0)).cast("long"))) for k in range(bits // 4)
    ]
    return F.concat(*digits)


def hamming64(a: Column, b: Column) -> Column:
    """PRJ-13: differing bits of two 16-digit hex hashes; null where one is not such a hash."""
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    valid = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    return F.when(valid, F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9))))


# fixed values: limits of similarity and of differing bits
WITH_HASH = (("EXACT_DUPLICATE", 2, 0.992), ("FORMAT_VARIANT", 7, 0.955), ("SERIES_VARIANT", None, 0.89))
WITHOUT_HASH = (("EXACT_DUPLICATE", 0.985), ("FORMAT_VARIANT", 0.945), ("SERIES_VARIANT", 0.89))


def classify_variant(score: Column, distance: Column | None = None, shift: float = 0.0) -> Column:
    """PRJ-14: kind of a pair of images. ``shift`` is added to the similarity limits."""
    out = F.when(F.lit(False), F.lit(""))
    if distance is not None:
        for kind, bits, least in WITH_HASH:
            near = score >= least + shift
            out = out.when(distance.isNotNull() & (near | (distance <= bits) if bits is not None else near), kind)
    for kind, least in WITHOUT_HASH:
        out = out.when(score >= least + shift, kind)
    return out.otherwise("RELATED")
