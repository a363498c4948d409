"""What charts show, computed where the data is: aggregates small enough to draw come out."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregate, clip, right_closed_bin
from ..operators.index import filter_by_groups, filter_by_value_thresholds, get_indexes, top_bottom
from ..operators.periods import Moment, to_utc
from ..options import column
from ..sources import as_table, validate_columns

_UNITS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def _truncated(period: str, date: str) -> Any:
    unit = _UNITS.get(period.upper(), period.lower())
    if unit not in _UNITS.values():
        raise ValueError(f"period must be one of {sorted(_UNITS)}")
    return F.date_trunc(unit, F.col(date)).cast("date")


def time_series(df: Any, value_col: str, period: str = "D", agg_func: str = "sum", group_col: str | None = None) -> DataFrame:
    """``period_start[, group], value``: an aggregate per period; pivot by group for a line each."""
    df, date = as_table(df), column("transaction_date")
    validate_columns(df, [date, value_col, *([group_col] if group_col else [])])
    return df.groupBy(_truncated(period, date).alias("period_start"), *([group_col] if group_col else [])).agg(aggregate(agg_func, value_col).alias("value"))


def broken_timeline(df: Any, category_col: str, value_col: str, period: str = "D", agg_func: str = "sum", threshold: float | None = None) -> DataFrame:
    """``category, segment_start, periods``: runs of consecutive days or weeks in which a category has
    rows (of at least ``threshold``)."""
    df, date = as_table(df), column("transaction_date")
    if period not in ("D", "W"):
        raise ValueError("period must be 'D' or 'W'")
    validate_columns(df, [date, category_col, value_col])
    rows = df if threshold is None else df.filter(F.col(value_col) >= threshold)
    rows = rows.filter(F.col(category_col).isNotNull() & F.col(date).isNotNull())
    by = rows.groupBy(F.col(category_col).alias("category"), _truncated(period, date).alias("p")).agg(aggregate(agg_func, value_col).alias("value"))
    days = {"D": 1, "W": 7}[period]
    order = Window.partitionBy("category").orderBy("p")
    gap = F.coalesce((F.datediff("p", F.lag("p").over(order)) > days).cast("int"), F.lit(1))
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = by.withColumn("new", gap).withColumn("island", island)
    return runs.groupBy("category", "island").agg(F.min("p").alias("segment_start"), F.count("*").alias("periods")).drop("island")


def period_on_period(df: Any, value_col: str, periods: list[tuple[Moment, Moment]], agg_func: str = "sum") -> DataFrame:
    """``period, aligned_date, value``: every window's days moved by whole years onto the first's."""
    df, date = as_table(df), column("transaction_date")
    if len(periods) < 2:
        raise ValueError("at least two periods are needed")
    validate_columns(df, [date, value_col])
    spans = [(to_utc(a), to_utc(b)) for a, b in periods]
    table = F.array(*[F.struct(F.lit(f"{a:%Y-%m-%d} to {b:%Y-%m-%d}").alias("period"), F.lit(a.date()).alias("a"), F.lit(b.date()).alias("b"), F.lit(12 * (spans[0][0].year - a.year)).alias("months")) for a, b in spans])
    day = F.col(date).cast("date")
    hits = df.withColumn("__w", F.explode(F.filter(table, lambda w: (w["a"] <= day) & (day <= w["b"]))))
    aligned = F.add_months(day, F.col("__w.months"))
    return hits.groupBy(F.col("__w.period").alias("period"), aligned.alias("aligned_date")).agg(aggregate(agg_func, value_col).alias("value"))


def price_bands(df: Any, value_col: str, group_col: str, bins: int | list[float]) -> DataFrame:
    """``group, bin, low, high, share`` of a group's rows in right-closed price bands.

    Rows beyond the bands count in the denominator; empty bands are left out.  A number of bins
    means equal widths between the extremes, found by a job.
    """
    df = as_table(df)
    validate_columns(df, [value_col, group_col])
    if isinstance(bins, bool) or not isinstance(bins, (int, list)):
        raise TypeError("bins must be a number or a list of edges")
    known = df.filter(F.col(value_col).isNotNull() & F.col(group_col).isNotNull()).select(F.col(group_col).alias("group"), F.col(value_col).cast("double").alias("v"))
    if isinstance(bins, int):
        if bins < 1:
            raise ValueError("bins must be at least 1")
        low, high = known.agg(F.min("v"), F.max("v")).head()
        if low is None:
            raise ValueError("no data to plot")
        bins = [low + (high - low) * i / bins for i in range(bins)] + [high] if high > low else [low - 0.5, high + 0.5]
    edges = [float(b) for b in bins]
    counted = known.groupBy("group", right_closed_bin(F.col("v"), edges).alias("bin")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("group"))
    at = lambda shift: F.get(F.lit(edges), F.col("bin") + shift)
    return counted.withColumn("share", share).filter("bin is not null").select("group", "bin", at(0).alias("low"), at(1).alias("high"), "share")


def histogram_bins(df: Any, value_col: str, bins: int, low: float, high: float, range_method: str = "clip", group_col: str | None = None, cumulative: bool = False, density: bool = False) -> DataFrame:
    """``[group,] bin, bin_left, bin_right, n``: equal widths, left-closed, the last bin closed.

    Values beyond the bounds count in the outer bins (clip) or not at all (fillna).
    """
    df = as_table(df)
    if range_method not in ("clip", "fillna"):
        raise ValueError("range_method must be 'clip' or 'fillna'")
    if bins < 1 or low >= high:
        raise ValueError("bins must be positive and low below high")
    validate_columns(df, [value_col, *([group_col] if group_col else [])])
    value = F.col(value_col).cast("double")
    value = clip(value, low, high) if range_method == "clip" else F.when(value.between(low, high), value)
    width = (high - low) / bins
    number = F.when(value.isNotNull(), F.least(F.floor((value - low) / width), F.lit(bins - 1))).cast("int")
    keys = [F.col(group_col).alias("group")] if group_col else []
    counted = df.groupBy(*keys, number.alias("bin")).agg(F.count("*").alias("n")).filter("bin is not null")
    names = ["group"] if group_col else []
    if cumulative:
        counted = counted.withColumn("n", F.sum("n").over(Window.partitionBy(*names).orderBy("bin")))
    if density:
        top = F.max if cumulative else F.sum
        counted = counted.withColumn("n", F.col("n") / top("n").over(Window.partitionBy(*names)) / (1 if cumulative else width))
    return counted.select(*names, "bin", (F.lit(low) + F.col("bin") * width).alias("bin_left"), (F.lit(low) + (F.col("bin") + 1) * width).alias("bin_right"), "n")


def bar_shares(df: DataFrame, x_col: str, value_cols: list[str], share_of: str = "bar") -> DataFrame:
    """``x, series, value, share`` (percent): of the bar's sum or of the series' sum; null for sums of 0."""
    if share_of not in ("bar", "series"):
        raise ValueError("share_of must be 'bar' or 'series'")
    long = df.select(F.col(x_col).alias("x"), *[F.col(c).cast("double").alias(c) for c in value_cols]).unpivot("x", value_cols, "series", "value")
    total = F.sum("value").over(Window.partitionBy("x" if share_of == "bar" else "series"))
    return long.withColumn("share", F.col("value") / F.nullif(total, F.lit(0.0)) * 100)


def line_series(df: DataFrame, x_col: str, value_col: str, group_col: str, highlight: list[str] | None = None, fill: float | None = None, most: int = 1000) -> DataFrame:
    """``x`` and a column per group; with ``highlight`` those groups come last (drawn on top).

    A job finds the groups; more than ``most`` are a ValueError, for each becomes a column."""
    groups = sorted(r[0] for r in df.select(group_col).filter(F.col(group_col).isNotNull()).distinct().limit(most + 1).collect())
    if len(groups) > most:
        raise ValueError(f"{group_col} has more than {most} groups")
    if highlight and (unknown := set(highlight) - set(groups)):
        raise ValueError(f"unknown groups to highlight: {sorted(unknown)}")
    groups = [g for g in groups if g not in (highlight or [])] + list(highlight or [])
    out = df.groupBy(F.col(x_col).alias("x")).pivot(group_col, groups).agg(F.first(value_col)).orderBy("x")
    return out if fill is None else out.na.fill(fill)


def area_series(df: DataFrame, x_col: str, value_cols: list[str], group_col: str | None = None) -> DataFrame:
    """``x`` and a column per area to be stacked: the value columns, or the one value's groups; nothing is 0."""
    if group_col is not None:
        if len(value_cols) != 1:
            raise ValueError("areas by group take one value column")
        return line_series(df, x_col, value_cols[0], group_col, fill=0)
    return df.select(F.col(x_col).alias("x"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in value_cols]).orderBy("x")


def sorted_bars(df: DataFrame, x_col: str, value_cols: list[str], sort_order: str | None = None) -> DataFrame:
    """``x`` and the bars' values, in the order of the first value if one is asked for."""
    if sort_order not in (None, "ascending", "descending"):
        raise ValueError("sort_order must be 'ascending', 'descending' or None")
    out = df.select(F.col(x_col).alias("x"), *value_cols)
    if sort_order is None:
        return out
    by = F.col(value_cols[0])
    return out.orderBy(by.asc_nulls_last() if sort_order == "ascending" else by.desc_nulls_last(), "x")


def scatter_points(df: DataFrame, x_col: str, y_col: str, size_col: str | None = None, size_scale: float = 1.0, label_col: str | None = None, group_col: str | None = None) -> DataFrame:
    """Points whose coordinates are known, with bubble sizes, labels and the series they are of."""
    extra = [F.col(group_col).alias("series")] if group_col else []
    extra += [(F.col(size_col) * F.lit(size_scale)).alias("size")] if size_col else []
    extra += [F.col(label_col).alias("label")] if label_col else []
    return df.select(F.col(x_col).alias("x"), F.col(y_col).alias("y"), *extra).dropna(subset=["x", "y"])


def waterfall_steps(df: DataFrame, position_col: str, amount_col: str, remove_zero: bool = True) -> DataFrame:
    """``position, amount, base, share``: bars that begin where the ones before end; ``share`` in
    percent of the net amount.  Steps are the few bars of a chart."""
    rows = df.select(F.col(position_col).alias("position"), F.col(amount_col).cast("double").alias("amount"))
    rows = rows.filter("amount != 0") if remove_zero else rows
    before = F.sum("amount").over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("base", F.coalesce(before, F.lit(0.0))).withColumn("share", F.col("amount") / F.nullif(F.sum("amount").over(Window.partitionBy()), F.lit(0.0)) * 100)


def venn_sets(summary: DataFrame, value_col: str = "percent") -> DataFrame:
    """Areas of a two- or three-set diagram from a cross-shop summary; customers of no group are left out."""
    return summary.filter("group_labels != 'No Groups'").select("groups", "group_labels", F.col(value_col).alias("area"))


def cohort_labels(table: DataFrame, percentage: bool = False) -> DataFrame:
    """Cells of a cohort heat map with their texts."""
    text = F.concat(F.round(F.col("period_value") * 100).cast("int").cast("string"), F.lit("%")) if percentage else F.col("period_value").cast("string")
    return table.withColumn("label", text)


def regression(df: Any, x_col: str, y_col: str, kind: str = "linear") -> DataFrame:
    """``slope, intercept, r_squared`` of y over x by least squares, after logarithms where the kind
    has them (power: both, logarithmic: x, exponential: y); R-squared in y's own space.

    ``intercept`` is the constant of the shown formula: a factor for power and exponential curves.
    """
    if kind not in ("linear", "power", "logarithmic", "exponential"):
        raise ValueError(f"unknown kind of regression: {kind}")
    df = as_table(df)
    validate_columns(df, [x_col, y_col])
    x, y = F.col("x"), F.col("y")
    rows = df.select(F.col(x_col).cast("double").alias("x"), F.col(y_col).cast("double").alias("y")).dropna()
    if kind in ("power", "logarithmic"):
        rows = rows.filter("x > 0")
    if kind in ("power", "exponential"):
        rows = rows.filter("y > 0")
    fit_x = F.ln(x) if kind in ("power", "logarithmic") else x
    fit_y = F.ln(y) if kind in ("power", "exponential") else y
    line = rows.agg(F.regr_slope(fit_y, fit_x).alias("slope"), F.regr_intercept(fit_y, fit_x).alias("const"), F.avg("y").alias("mean"))
    guess = F.col("const") + F.col("slope") * fit_x
    guess = F.exp(guess) if kind in ("power", "exponential") else guess
    left = rows.crossJoin(F.broadcast(line)).agg(
        F.first("slope").alias("slope"), F.first("const").alias("const"), F.sum(F.pow(y - guess, F.lit(2.0))).alias("rest"), F.sum(F.pow(y - F.col("mean"), F.lit(2.0))).alias("all")
    )
    shown = F.exp("const") if kind in ("power", "exponential") else F.col("const")
    return left.select("slope", shown.alias("intercept"), (F.lit(1.0) - F.col("rest") / F.nullif(F.col("all"), F.lit(0.0))).alias("r_squared"))


def index_bars(
    df: Any,
    value_to_index: Any,
    index_col: str,
    value_col: str,
    group_col: str,
    series_col: str | None = None,
    agg_func: str = "sum",
    sort_by: str | None = "group",
    ascending: bool = True,
    exclude_groups: list | None = None,
    include_only_groups: list | None = None,
    filter_above: float | None = None,
    filter_below: float | None = None,
    top_n: int | None = None,
    bottom_n: int | None = None,
    highlight: tuple[float, float] | None = None,
) -> DataFrame:
    """Bars of indexes around 0 (100 is taken off): filtered, cut to the top and bottom ones, sorted by
    group or value, and with ``tone`` telling which leave the highlighted range."""
    if sort_by not in (None, "group", "value"):
        raise ValueError("sort_by must be 'group', 'value' or None")
    if series_col and (top_n or bottom_n or sort_by == "value"):
        raise ValueError("series take neither a top and bottom nor an order by value")
    found = filter_by_groups(get_indexes(df, value_to_index, index_col, value_col, group_col, series_col, agg_func, 100), group_col, exclude_groups, include_only_groups)
    found = filter_by_value_thresholds(found, filter_above, filter_below, check=filter_above is not None or filter_below is not None)
    found = top_bottom(found, top_n, bottom_n)
    if highlight is not None:
        low, high = highlight
        found = found.withColumn("tone", F.when(F.col("index") < low - 100, F.lit("negative")).when(F.col("index") > high - 100, F.lit("positive")).otherwise(F.lit("neutral")))
    if sort_by is None:
        return found
    keys = [group_col if sort_by == "group" else "index"]
    return found.orderBy(*[F.col(k).asc() if ascending else F.col(k).desc() for k in keys])
