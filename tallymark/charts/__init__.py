"""Data of charts as DataFrames; drawing is optional and needs matplotlib (``charts.render``)."""

from .data import (
    area_series,
    bar_shares,
    broken_timeline,
    cohort_labels,
    histogram_bins,
    index_bars,
    line_series,
    period_on_period,
    price_bands,
    regression,
    scatter_points,
    sorted_bars,
    time_series,
    venn_sets,
    waterfall_steps,
)

__all__ = [
    "area_series", "bar_shares", "broken_timeline", "cohort_labels", "histogram_bins", "index_bars", "line_series", "period_on_period", "price_bands", "regression",
    "scatter_points", "sorted_bars", "time_series", "venn_sets", "waterfall_steps",
]
