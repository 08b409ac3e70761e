"""Scalar expressions of the ranking features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gap(now: Column, last: Column) -> Column:
    """log1p of the time since, 0 if there was none or it lies ahead."""
    return F.coalesce(F.log1p(F.greatest(now - last, F.lit(0)).cast("double")), F.lit(0.0))


def hyperbolic(now: Column, last: Column, span: float, scale: float = 1.0) -> Column:
    """1 / (1 + scale * age), age as a share of the span; 0 without a last time (greatest() would pass over a null)."""
    age = F.greatest(now - last, F.lit(0)) / F.lit(float(span))
    return F.when(last.isNull(), F.lit(0.0)).otherwise(1.0 / (1.0 + age * scale))


def decayed(count: Column, now: Column, last: Column, span: float, beta: float) -> Column:
    age = F.greatest(now - last, F.lit(0)) / F.lit(float(span))
    return F.coalesce(F.when((count > 0) & last.isNotNull(), F.log1p(count.cast("double")) * F.exp(-beta * age * 100.0)), F.lit(0.0))


def clipped_trend(recent: Column, older: Column) -> Column:
    return F.greatest(F.least(F.log1p(recent.cast("double")) - F.log1p(older.cast("double")), F.lit(5.0)), F.lit(-5.0)) / 5.0


def discount(rank: Column, power: float) -> Column:
    return 1.0 / F.pow(rank.cast("double"), F.lit(power))


def id_bucket(value: Column) -> Column:
    return F.pmod(value, F.lit(997)) / 996.0


def entropy_term(p: Column) -> Column:
    return -p * F.ln(F.greatest(p, F.lit(1e-12)))


def logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """Divided by the length, at least 1e-6."""
    length = F.greatest(F.sqrt(dot(a, a)), F.lit(1e-6))
    return F.transform(a, lambda x: x.cast("double") / length)


def finite(value: Column, default: float = 0.0) -> Column:
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def time_triple(time: Column, low: float, span: float, gap: Column, gap_scale: float, hist: Column, hist_scale: float) -> list[Column]:
    """Position in the whole span, scaled log gap, scaled log history length."""
    return [(time - low) / F.lit(float(span)), F.log1p(F.greatest(gap, F.lit(0)).cast("double")) / gap_scale, F.log1p(hist.cast("double")) / hist_scale]


def popularity_bucket(count: Column) -> Column:
    out = F.when(count <= 0, F.lit("0"))
    for name, low, high in POP_BUCKETS:
        out = out.when(count.between(low, high), F.lit(name))
    return out.otherwise(F.lit(POP_BUCKETS[-1][0]))


# Popularity buckets (name, least, largest).
POP_BUCKETS = [("1", 1, 1), ("2-5", 2, 5), ("6-10", 6, 10), ("11-20", 11, 20), ("21-50", 21, 50), ("51-100", 51, 100), ("101-500", 101, 500), (">500", 501, 10**12)]


def padded(values: Column, width: int) -> Column:
    """The last `width` values, zeros before them."""
    last = F.slice(values, F.greatest(F.size(values) - width + 1, F.lit(1)), F.lit(width))
    return F.concat(F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(width) - F.size(last), F.lit(0))), last)


def positive_int(value, name: str) -> int:
    if int(value) != value or value < 1:
        raise ValueError(f"{name} must be a positive integer")
    return int(value)


def non_negative(value, name: str) -> float:
    if not float(value) >= 0:
        raise ValueError(f"{name} must not be negative")
    return float(value)


def one_of(value: str, allowed: set[str] | list[str], name: str) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(sorted(allowed))}")
    return value


def blends(text: str) -> list[float]:
    out = [float(x) for x in text.split(",") if x.strip()]
    if not out or any(not 0 <= x <= 1 for x in out):
        raise ValueError("blends must be numbers from 0 to 1")
    return out


def blend_name(value: float) -> str:
    return f"{value:.2f}".replace(".", "p")
