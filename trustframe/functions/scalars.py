"""Scalar expressions used by scoring, trust and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def predict_at_half(z: Column) -> Column:
    """1 when the probability of logit ``z`` is at least one half."""
    return F.when(sigmoid(z) >= 0.5, F.lit(1)).otherwise(F.lit(0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def logit_loss(z: Column, y: Column) -> Column:
    """Cross entropy of a logit, in the form that does not overflow."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def round_half_even(x: Column) -> Column:
    return F.rint(x)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(numerator / F.nullif(denominator.cast("double"), F.lit(0.0)), F.lit(0.0))


def parse_int_list(text: Column) -> Column:
    """``"1, 2,,5"`` to ``[1, 2, 5]``."""
    parts = F.transform(F.split(text, ","), lambda part: F.trim(part))
    return F.transform(F.filter(parts, lambda part: part != ""), lambda part: part.cast("int"))


def iso_utc(moment: Column) -> Column:
    """ISO-8601 text of a timestamp in UTC, whatever the time zone of the session."""
    utc = F.to_utc_timestamp(moment, F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def format_int_list(values: Column) -> Column:
    return F.concat_ws(",", F.transform(values, lambda value: value.cast("string")))


def balanced_sum(terms: list[str]) -> str:
    """Sum of many SQL terms as a shallow expression tree."""
    if not terms:
        return "0.0D"
    while len(terms) > 1:
        paired = [f"({a} + {b})" for a, b in zip(terms[::2], terms[1::2])]
        terms = paired + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]
