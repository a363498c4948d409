"""Column expressions: safe ratios, aggregates by name, distances, numbers as text."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_DOWN, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_metric(numerator: Column | str, denominator: Column | str, scale: float = 100) -> Column:
    """numerator / denominator * scale, null where the denominator is 0."""
    return safe_div(numerator, denominator) * F.lit(scale)


def safe_div(numerator: Column | str, denominator: Column | str) -> Column:
    """Double division, null where the denominator is 0."""
    top, bottom = (F.col(c) if isinstance(c, str) else c for c in (numerator, denominator))
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


_AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "nunique": F.count_distinct,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "std": F.stddev_samp,
    "var": F.var_samp,
    "mode": F.mode,
    "first": F.first,
    "last": F.last,
    "any": F.bool_or,
    "all": F.bool_and,
    "approx_nunique": F.approx_count_distinct,
    "approx_median": lambda c: F.percentile_approx(c, F.lit(0.5)),
}


def aggregate(name: str, column: Column | str, where: Column | None = None) -> Column:
    """An aggregate by name, over the rows that satisfy ``where``."""
    if name not in _AGGREGATES:
        raise ValueError(f"Aggregation function '{name}' not available; choose one of {sorted(_AGGREGATES)}")
    column = F.col(f"`{column}`") if isinstance(column, str) else column
    return _AGGREGATES[name](column if where is None else F.when(where, column))


def haversine_distance(lat: Column | str, lon: Column | str, to_lat: Column | str, to_lon: Column | str, radius: float = 6371.0) -> Column:
    """Great-circle distance in the radius's unit."""
    lat, lon, to_lat, to_lon = (F.radians(F.col(c) if isinstance(c, str) else c) for c in (lat, lon, to_lat, to_lon))
    chord = F.pow(F.sin((to_lat - lat) / 2), 2) + F.cos(lat) * F.cos(to_lat) * F.pow(F.sin((to_lon - lon) / 2), 2)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def clip(column: Column, low: float | None, high: float | None) -> Column:
    """Values beyond the bounds become the bounds; nulls stay null."""
    if low is not None:
        column = F.when(column < low, F.lit(low)).otherwise(column)
    return column if high is None else F.when(column > high, F.lit(high)).otherwise(column)


def right_closed_bin(column: Column, edges: list[float]) -> Column:
    """Number of the bin (edges[i], edges[i + 1]] that holds the value, from 0; the first bin holds
    its left edge too; null outside."""
    if len(edges) < 2 or sorted(set(edges)) != list(edges):
        raise ValueError("edges must rise")
    out = F.when((column >= edges[0]) & (column <= edges[1]), F.lit(0))
    for i in range(1, len(edges) - 1):
        out = out.when((column > edges[i]) & (column <= edges[i + 1]), F.lit(i))
    return out


MAGNITUDES = ["", "K", "M", "B", "T", "P"]


def human_number(value: float, decimals: int = 0, prefix: str = "", trim: bool = False) -> str:
    """1234 -> 1K: a chart label with the suffix of the power of a thousand; ``trim`` leaves zeros at
    the end of decimals out."""
    size, power = abs(value), 0
    while power < len(MAGNITUDES) - 1 and round(size, decimals) >= 1000:
        size, power = size / 1000, power + 1
    shown = f"{size:.{decimals}f}"
    if trim and "." in shown:
        shown = shown.rstrip("0").rstrip(".")
    return f"{prefix}{'-' if value < 0 and round(size, decimals) else ''}{shown}{MAGNITUDES[power]}"


def truncate_to_x_digits(number: str, digits: int) -> str:
    """Cut a short number (``-1234.567K``) to its first digits without rounding: ``digits`` in all where
    the whole part is shorter, else all of that and ``digits`` decimals; numbers under 0.0001 are rounded."""
    suffix = next((m for m in MAGNITUDES[1:] if number.endswith(m)), "")
    body = number.removesuffix(suffix)
    value = Decimal(body)
    if not value:
        return f"0{suffix}"
    if abs(value) < Decimal("0.0001"):
        shown = f"{abs(value):.{digits}f}"
        return shown.rstrip("0").rstrip(".") if "." in shown else shown
    whole = len(body.lstrip("-").partition(".")[0])
    places = digits - whole if digits > whole else digits
    cut = f"{value.quantize(Decimal(1).scaleb(-places), ROUND_DOWN):f}"
    return (cut.rstrip("0").rstrip(".") if "." in cut else cut) + suffix


def distinct_decimals(ticks: list[float], low: float, high: float, most: int = 10) -> int:
    """The fewest decimals with which the short labels of the ticks between two limits all differ."""
    shown = [t for t in ticks if low <= t <= high]
    return next((d for d in range(most) if len({human_number(t, d, trim=True) for t in shown}) == len(shown)), most)
