"""Geometry and measured properties of images as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("left", "top", "width", "height")


def bbox_percent(bbox: Column, width: Column, height: Column) -> Column:
    """PRJ-7: box (x1, y1, x2, y2) in per cent of the image, four decimals; null without sizes or four numbers."""
    x1, y1, x2, y2 = (F.get(bbox, F.lit(k)).cast("double") for k in range(4))
    parts = (x1 / width, y1 / height, (x2 - x1) / width, (y2 - y1) / height)
    box = F.struct(*(F.round(p * 100, 4).alias(n) for p, n in zip(parts, EDGES, strict=True)))
    return F.when((width > 0) & (height > 0) & (F.size(bbox) == 4), box)


def mwg_region(percent: Column, bbox: Column, width: Column, height: Column) -> Column:
    """PRJ-8: centre and size of a region in 0..1, six decimals, from per cent, else from pixels; null where neither is known."""
    p = [percent[e] / 100 for e in EDGES]
    from_percent = (p[0] + p[2] / 2, p[1] + p[3] / 2, p[2], p[3])
    x1, y1, x2, y2 = (F.get(bbox, F.lit(k)).cast("double") for k in range(4))
    from_pixels = ((x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height)
    made = lambda parts: F.struct(*(F.round(v, 6).alias(n) for v, n in zip(parts, ("x", "y", "w", "h"), strict=True)))
    return F.when(percent.isNotNull(), made(from_percent)).when((width > 0) & (height > 0) & (F.size(bbox) == 4), made(from_pixels))


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1))


def carrier_type(r: Column, g: Column, b: Column, saturation: Column) -> Column:
    """PRJ-9: photographic process from channel means and saturation (0-255); the first rule that holds."""
    return (
        F.when((b > r * 1.35) & (b > 70) & (saturation > 40), "cyanotype")
        .when((r > b * 1.22) & (r > g) & (saturation > 25), "albumen")
        .when((saturation > 55) & (F.abs(r - b) > 20), "colour")
        .otherwise("silver_gelatin")
    )


def format_band(ratio: Column) -> Column:
    """PRJ-9: format by aspect ratio."""
    return F.when(ratio.between(1.52, 1.68), "carte_de_visite").when((ratio >= 1.40) & (ratio < 1.52), "cabinet").when(ratio.between(1.0, 1.12), "square").when(ratio.between(1.20, 1.38), "large_plate").otherwise("normal")


def condition(contrast: Column) -> Column:
    """PRJ-9: state by mean standard deviation of the channels."""
    return F.when(contrast < 28, "faded").when(contrast > 65, "good").otherwise("normal")


def scale_factors(width: Column, height: Column, tile: int = 512) -> Column:
    """PRJ-17: 1, 2, 4, ... while factor * tile is at most twice the longer side; 1 at least."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.filter(steps, lambda s: (s == 1) | (s * tile <= F.greatest(width, height) * 2))


def preview_sizes(width: Column, height: Column) -> Column:
    """PRJ-17: standard sizes below the longer side."""
    return F.filter(F.array(*(F.lit(s) for s in (256, 512, 1024, 2048))), lambda s: s < F.greatest(width, height))


def person_name(label: Column, cluster_name: Column, cluster: Column) -> Column:
    """PRJ-18: label, else the cluster's name, else Person #<id>."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(label), blank(cluster_name), F.concat(F.lit("Person #"), F.regexp_replace(cluster, "^cluster_", "")))


def turned(angles: Column) -> Column:
    """PRJ-20: accumulated rotation modulo 360."""
    return F.pmod(angles, F.lit(360))
