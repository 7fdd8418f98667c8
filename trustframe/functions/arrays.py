"""Arithmetic on ``array<double>`` columns: one model state or update per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, factor: Column) -> Column:
    """Every element times ``factor``, which is worked out once per row and not once per element."""
    return F.zip_with(a, F.array_repeat(factor, F.size(a)), lambda x, f: x * f)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x * x))


def clip_to_norm(a: Column, max_norm: float) -> Column:
    """Shrink to ``max_norm`` when longer; a zero or short vector is returned unchanged."""
    shrink = F.lit(float(max_norm)) / F.nullif(l2_norm(a), F.lit(0.0))
    return scale(a, F.least(F.lit(1.0), shrink))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector has no length."""
    return F.coalesce(dot(a, b) / F.nullif(l2_norm(a) * l2_norm(b), F.lit(0.0)), F.lit(0.0))
