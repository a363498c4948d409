"""The revenue tree: how customers, visits, baskets and prices explain a change in spend."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregate, safe_div
from ..options import column, get_option
from ..plans.grouping import Distinct, aggregate_sets
from ..plugin import plugins
from ..sources import as_table, validate_columns
from .base import Result, listed


def _name(what: str, *suffixes: str) -> str:
    return column(what, *suffixes)


SPEND, PEOPLE, TRIPS, UNITS = "agg.unit_spend", "agg.customer_id", "agg.transaction_id", "agg.unit_quantity"
PER_PERSON, PER_TRIP, FREQUENCY = "calc.spend_per_customer", "calc.spend_per_transaction", "calc.transactions_per_customer"
BASKET, PRICE = "calc.units_per_transaction", "calc.price_per_unit"


@plugins.extensible
def tree_kpis(both: DataFrame, keys: list[str], with_units: bool) -> DataFrame:
    """From totals of both periods (``spend_p1, spend_p2, customers_p1, ...``) all measures of the tree.

    Ratios without a denominator are 0, also in a period without rows; relative changes from 0 and
    elasticities without a change are null.  A contribution is the part of the change in spend that
    a factor explains, mixed terms being shared equally between the factors of each split; so
    the contributions of a split add up to that of the factor it splits.
    """
    base = [SPEND, PEOPLE, TRIPS] + ([UNITS] if with_units else [])
    ratios = {PER_PERSON: (SPEND, PEOPLE), PER_TRIP: (SPEND, TRIPS), FREQUENCY: (TRIPS, PEOPLE)}
    if with_units:
        ratios |= {BASKET: (UNITS, TRIPS), PRICE: (SPEND, UNITS)}
    ends = ("period_1", "period_2")
    both = both.withColumns({_name(m, e): F.coalesce(F.col(_name(m, e)).cast("double"), F.lit(0.0)) for m in base for e in ends})
    both = both.withColumns({_name(r, e): F.coalesce(safe_div(_name(a, e), _name(b, e)), F.lit(0.0)) for r, (a, b) in ratios.items() for e in ends})
    measures = [*base, *ratios]
    at = lambda m, e: F.col(_name(m, e))
    delta = lambda m: at(m, "period_2") - at(m, "period_1")
    made: dict[str, Column] = {}
    for m in measures:
        made[_name(m, "difference")] = delta(m)
        made[_name(m, "percent_difference")] = safe_div(delta(m), at(m, "period_1"))

    def midpoint(m: str) -> Column:
        return safe_div(delta(m), (at(m, "period_1") + at(m, "period_2")) / 2)

    made[_name("calc.frequency_elasticity")] = safe_div(midpoint(FREQUENCY), midpoint(PER_PERSON))
    if with_units:
        made[_name("calc.price_elasticity")] = safe_div(midpoint(UNITS), midpoint(PRICE))

    def split(whole: str, factor: str, other: str) -> Column:
        """The factor's part of the change in whole = factor * other."""
        return at(whole, "period_2") - at(factor, "period_1") * at(other, "period_2") - delta(factor) * delta(other) / 2

    people, mixed = at(PEOPLE, "period_2"), delta(PEOPLE) * delta(PER_PERSON)
    made[_name(PEOPLE, "contribution")] = split(SPEND, PEOPLE, PER_PERSON)
    made[_name(PER_PERSON, "contribution")] = split(SPEND, PER_PERSON, PEOPLE)
    made[_name(FREQUENCY, "contribution")] = split(PER_PERSON, FREQUENCY, PER_TRIP) * people - mixed / 4
    made[_name(PER_TRIP, "contribution")] = split(PER_PERSON, PER_TRIP, FREQUENCY) * people - mixed / 4
    if with_units:
        visits, inner = at(FREQUENCY, "period_2"), delta(FREQUENCY) * delta(PER_TRIP) / 4
        made[_name(PRICE, "contribution")] = (split(PER_TRIP, PRICE, BASKET) * visits - inner) * people - mixed / 8
        made[_name(BASKET, "contribution")] = (split(PER_TRIP, BASKET, PRICE) * visits - inner) * people - mixed / 8
    out = both.withColumns(made)
    order = [n for m in measures for n in [_name(m, *([e])) for e in ends] + [_name(m, "difference"), _name(m, "percent_difference")]]
    rest = [c for c in made if c not in order]
    return out.select(*[F.col(f"`{k}`") for k in keys], *order, *rest)


@plugins.extensible
def calc_tree_kpis(df: Any, p1_index: Any, p2_index: Any) -> Any:
    """The tree's measures as pandas from a pandas frame of totals (spend, customers, transactions and, if
    there, units), a row for each group and period: masks tell the periods' rows, the frame's index the
    groups, which may lack one of the periods; two rows are the two periods, whatever their index.  For a
    few rows; :class:`RevenueTree` takes tables."""
    import pandas as pd

    if len(p1_index) != len(df) or len(p2_index) != len(df):
        raise ValueError(f"a mask needs a value for each of the {len(df)} rows")
    base = [_name(m) for m in (SPEND, PEOPLE, TRIPS)]
    if missing := [c for c in base if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    base += [_name(UNITS)] if _name(UNITS) in df.columns else []
    sides = [df[[bool(x) for x in mask]][base].add_suffix("_" + end) for mask, end in ((p1_index, column_suffix("period_1")), (p2_index, column_suffix("period_2")))]
    both = pd.concat([s.reset_index(drop=True) for s in sides] if len(df) == 2 else sides, axis=1)
    spread = as_table(both.astype("float64").reset_index(drop=True).assign(__row=range(len(both))))
    out = tree_kpis(spread, ["__row"], len(base) == 4)
    out = getattr(out, "unwrap", lambda: out)().toPandas().sort_values("__row").drop(columns="__row")
    return out.set_axis(both.index, axis=0)


def column_suffix(name: str) -> str:
    return get_option(f"column.suffix.{name}")


@plugins.extensible
class RevenueTree(Result):
    """The tree between two values of ``period_col``, overall or by groups.

    The two periods are filtered first and meet in one conditional aggregation by group, so a group
    of one period only is kept with zeros for the other.
    """

    def __init__(self, df: Any, period_col: str, p1_value: Any, p2_value: Any, group_col: str | list[str] | None = None) -> None:
        df, groups = as_table(df), listed(group_col)
        spend, customer, trip, units = (column(c) for c in ("unit_spend", "customer_id", "transaction_id", "unit_quantity"))
        validate_columns(df, [spend, customer, trip, period_col, *groups])
        self.has_units = units in df.columns
        rows = df.filter(F.col(period_col).isin(p1_value, p2_value))
        totals = [(SPEND, spend, "sum"), (PEOPLE, customer, "nunique"), (TRIPS, trip, "nunique")] + ([(UNITS, units, "sum")] if self.has_units else [])
        cells: dict[str, Column | Distinct] = {}
        for m, c, f in totals:
            for p, e in ((p1_value, "period_1"), (p2_value, "period_2")):
                where = F.col(period_col) == F.lit(p)
                cells[_name(m, e)] = Distinct(c, where) if f == "nunique" else aggregate(f, c, where)
        both = aggregate_sets(rows, groups, [tuple(groups)], cells, {})
        self.table, self.index = tree_kpis(both, groups, self.has_units), groups

    def draw_tree(self, row: dict[str, Any] | None = None, value_labels: tuple[str, str] | None = None, ax: Any = None) -> Any:
        """Draw the tree of one row (see :meth:`nodes`); ``value_labels`` name the periods."""
        from ..charts.plots import tree_plot

        return tree_plot(self.nodes(row), _name(SPEND), value_labels or ("Current Period", "Previous Period"), ax=ax)

    def nodes(self, row: dict[str, Any] | None = None) -> dict[str, dict[str, Any]]:
        """The tree of one row (the only one by default) for drawing: per node its values, change,
        contribution and children."""
        row = row or self.table.head().asDict()
        children = {SPEND: [PEOPLE, PER_PERSON], PER_PERSON: [FREQUENCY, PER_TRIP], PER_TRIP: [BASKET, PRICE] if self.has_units else []}
        wanted = [SPEND, PEOPLE, PER_PERSON, FREQUENCY, PER_TRIP] + ([BASKET, PRICE] if self.has_units else [])
        tone = lambda x: "neutral" if x is None or abs(x) < 0.01 else "positive" if x > 0 else "negative"
        return {
            _name(m): {
                "period_1": row[_name(m, "period_1")], "period_2": row[_name(m, "period_2")], "difference": row[_name(m, "difference")],
                "percent_difference": row[_name(m, "percent_difference")], "contribution": row.get(_name(m, "contribution")),
                "tone": tone(row[_name(m, "percent_difference")]), "children": [_name(c) for c in children.get(m, [])],
            }
            for m in wanted
        }
