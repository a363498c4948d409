"""Segment statistics over grouping sets."""

from __future__ import annotations

import warnings
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import aggregate, safe_div
from ..options import column
from ..plans.grouping import Distinct, Median, aggregate_sets, plan
from ..plans.spread import parts
from ..sources import as_table, validate_columns
from ..storage import written
from .base import Result, listed

UNKNOWN = "__unknown"  # the condition of unidentified customers


def _measure(data: DataFrame, function: str, source: str, where: Column | None = None) -> Column | Distinct | Median:
    if function == "median" and isinstance(data.schema[source].dataType, NumericType):
        return Median(source, where)
    return Distinct(source, where) if function == "nunique" else aggregate(function, source, where)


class SegTransactionStats(Result):
    """Spend, transactions, units and customers of segments, and their ratios.

    ``grouping_sets`` is ``"total"``, ``"rollup"``, ``"cube"`` or a list of column tuples, whose
    members may be ``cube(...)`` and ``rollup(...)``; otherwise ``calc_total`` (default) and
    ``calc_rollup`` decide.  ``extra_aggs`` maps a name to (column, function).

    With ``unknown_customer_value`` (a condition or the id of unidentified customers) plain
    columns count identified customers, ``_unknown`` ones the others and ``_total`` all rows; a
    row whose condition is null is in the total only.
    """

    def __init__(
        self,
        data: Any,
        segment_col: str | list[str] = "segment_name",
        calc_total: bool | None = None,
        extra_aggs: dict[str, tuple[str, str]] | None = None,
        calc_rollup: bool | None = None,
        rollup_value: Any = "Total",
        unknown_customer_value: Any = None,
        grouping_sets: Any = None,
    ) -> None:
        data = as_table(data)
        segments = listed(segment_col, "segment_col")
        validate_columns(data, [column("unit_spend"), column("transaction_id"), *segments])
        if grouping_sets is None and calc_total is None and calc_rollup is None:
            warnings.warn("name grouping_sets='total' (or another one); the default of calc_total will go", FutureWarning, stacklevel=2)
        sets = plan(segments, grouping_sets, calc_total, calc_rollup)
        values = list(rollup_value) if isinstance(rollup_value, (list, tuple)) else [rollup_value] * len(segments)
        if len(values) != len(segments):
            raise ValueError(f"rollup_value must have one value for each of the {len(segments)} segment columns")
        self.has_units, self.has_customers = column("unit_quantity") in data.columns, column("customer_id") in data.columns
        self.extra = extra_aggs or {}
        for source, function in self.extra.values():
            validate_columns(data, [source])
            aggregate(function, source)
        self.segments, self.split = segments, unknown_customer_value is not None
        flag = self._flag(data, unknown_customer_value)
        flagged = data if flag is None else data.withColumn(UNKNOWN, flag)
        aggregates = self._aggregates(flagged)
        read = [column(c) for c in ("unit_spend", "transaction_id", "unit_quantity", "customer_id") if column(c) in data.columns]
        read += [*segments, *[c for c, _ in self.extra.values()], *([UNKNOWN] if self.split else [])]
        # a large table is computed once, for every distinct count and median reads it again
        kept = flagged.select(*[F.col(f"`{c}`") for c in dict.fromkeys(read)])

        def make() -> DataFrame:
            number = parts(data)
            rows = written(kept, "segments") if number else kept
            return self._ratios(aggregate_sets(rows, segments, sets, aggregates, dict(zip(segments, values, strict=True)), number))

        self._make = make

    @staticmethod
    def _flag(data: DataFrame, unknown: Any) -> Column | None:
        if unknown is None or isinstance(unknown, Column):
            return unknown
        validate_columns(data, [column("customer_id")])
        return F.col(column("customer_id")) == F.lit(unknown)

    def _aggregates(self, data: DataFrame) -> dict[str, Column | Distinct | Median]:
        standard = [("unit_spend", "unit_spend", "sum"), ("transaction_id", "transaction_id", "nunique")]
        standard += [("unit_quantity", "unit_quantity", "sum")] if self.has_units else []
        named = [(column(f"agg.{a}"), column(c), f) for a, c, f in standard]
        customers = (column("agg.customer_id"), column("customer_id"), "nunique")
        extra = [(name, c, f) for name, (c, f) in self.extra.items()]
        if not self.split:
            return {name: _measure(data, f, c) for name, c, f in [*named, *([customers] if self.has_customers else []), *extra]}
        flag = F.col(UNKNOWN)
        suffix, total = column("suffix.unknown_customer"), column("suffix.total")
        out = {}
        for name, c, f in [*named, *extra]:
            fill = name not in self.extra
            for ending, where in (("", ~flag), (f"_{suffix}", flag), (f"_{total}", None)):
                made = _measure(data, f, c, where)
                out[name + ending] = F.coalesce(made, F.lit(0)) if fill and where is not None and not isinstance(made, (Distinct, Median)) else made
        if self.has_customers:
            out[customers[0]] = Distinct(customers[1], ~flag)
        return out

    def _ratios(self, grouped: DataFrame) -> DataFrame:
        spend, trips, units, people = (column(f"agg.{c}") for c in ("unit_spend", "transaction_id", "unit_quantity", "customer_id"))
        by_trip = [("calc.spend_per_transaction", spend, trips)]
        if self.has_units:
            by_trip += [("calc.price_per_unit", spend, units), ("calc.units_per_transaction", units, trips)]
        by_person = [("calc.spend_per_customer", spend, people), ("calc.transactions_per_customer", trips, people)] if self.has_customers else []
        endings = ["", f"_{column('suffix.unknown_customer')}", f"_{column('suffix.total')}"] if self.split else [""]
        made = {column(n): safe_div(a, b) for n, a, b in by_person}
        made |= {column(n) + e: safe_div(a + e, b + e) for e in endings for n, a, b in by_trip}
        return grouped.withColumns(made)
