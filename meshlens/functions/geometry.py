"""Geometry as Column expressions: all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vector(prefix: str) -> Vector:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def unit(a: Vector) -> Vector:
    """Normalised; the zero vector has none (nulls)."""
    n = norm(a)
    return tuple(F.when(n > 0, c / n) for c in a)


def angle(a: Vector, b: Vector) -> Column:
    """Degrees between two vectors; 90 if one is zero, as a cosine of 0 gives."""
    d = norm(a) * norm(b)
    return F.degrees(F.acos(clip(F.when(d > 0, dot(a, b) / d).otherwise(0.0), -1.0, 1.0)))


def axis_angle(a: Vector, b: Vector) -> Column:
    """Degrees between two axes, without direction: 0 to 90."""
    d = norm(a) * norm(b)
    return F.degrees(F.acos(clip(F.abs(F.when(d > 0, dot(a, b) / d).otherwise(0.0)), 0.0, 1.0)))


def polar_degrees(x: Column, z: Column, ux: Column, uz: Column) -> Column:
    return F.degrees(F.atan2(z - uz, x - ux))


def falling_score(fraction: Column, limit: float) -> Column:
    """1 at no defects, 0 at ``limit`` and beyond."""
    return clip(1.0 - fraction / limit, 0.0, 1.0)


def letter_grade(score: Column) -> Column:
    return F.when(score >= 0.95, "A").when(score >= 0.85, "B").when(score >= 0.70, "C").when(score >= 0.50, "D").otherwise("F")


def heat_rgb(deviation: Column) -> tuple[Column, Column, Column]:
    """Green over yellow to red at 0, 22.5 and 45 degrees."""
    t = clip(deviation / 45.0, 0.0, 1.0)
    return F.floor(clip(2 * t, 0.0, 1.0) * 255).cast("int"), F.floor(clip(2 - 2 * t, 0.0, 1.0) * 255).cast("int"), F.lit(0)


def hue_rgb(t: Column) -> tuple[Column, Column, Column]:
    """Red over yellow, green, cyan and blue to magenta for t of 0 to 1; grey for null."""
    h = F.least(clip(t, 0.0, 1.0) * 300.0, F.lit(299.99)) / 60.0
    parts = (F.abs(h - 3) - 1, 2 - F.abs(h - 2), 2 - F.abs(h - 4))
    return tuple(F.when(t.isNull(), 127).otherwise(F.floor(clip(x, 0.0, 1.0) * 255).cast("int")) for x in parts)


def warm_rgb(shade: Column, value: Column) -> tuple[Column, Column, Column]:
    """Dark brown to cream by shade; nearly black where the value is not positive."""
    return tuple(F.when(value <= 0, dark).otherwise(F.floor(low + shade * span).cast("int")) for dark, low, span in ((10, 30, 225), (8, 20, 210), (6, 10, 175)))


def status_colour(score: Column) -> Column:
    return F.when(score >= 0.9, "#4caf50").when(score >= 0.75, "#2196f3").when(score >= 0.5, "#ff9800").otherwise("#f44336")


def bucket(score: Column, bounds: tuple[float, ...], names: tuple[str, ...]) -> Column:
    """The first name whose bound the score reaches, else the last name: page (0.9, 0.75, 0.5), batch (0.95, 0.85), text (0.75, 0.5)."""
    out = F.lit(names[-1])
    for least, name in reversed(list(zip(bounds, names))):
        out = F.when(score >= least, name).otherwise(out)
    return out


def scroll_id(path: Column) -> Column:
    """The scroll named in a path, else null."""
    return F.nullif(F.regexp_extract(path, r"PHerc\d+[A-Z]?|PHercParis\d+(?:Fr\d+)?", 0), F.lit(""))


def segment_name(path: Column) -> Column:
    """The 14 digits in a file's stem, else the stem."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return F.coalesce(F.nullif(F.regexp_extract(stem, r"\d{14}", 0), F.lit("")), stem)
