"""Gains and losses of a focus group between two periods, split by where they come from."""

from __future__ import annotations

import functools
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregate
from ..options import column
from ..sources import as_table, validate_columns
from .base import Result

PARTS = ["new", "lost", "increased_focus", "decreased_focus", "switch_from_comparison", "switch_to_comparison"]


def customer_parts(focus_p1: Column, comparison_p1: Column, focus_p2: Column, comparison_p2: Column) -> dict[str, Column]:
    """The six parts of a customer's change in the focus group; they sum up to the change.

    A customer of neither group before is new, of neither after is lost.  Otherwise the own change
    is what the comparison group's opposite change cannot explain, and the rest is switching.
    """
    zero = F.lit(0.0)
    change, other = focus_p2 - focus_p1, comparison_p2 - comparison_p1
    is_new = (focus_p1 == 0) & (comparison_p1 == 0)
    is_lost = ~is_new & (focus_p2 == 0) & (comparison_p2 == 0)
    net = change + other
    own = (
        F.when(change > 0, F.when(other > 0, change).otherwise(F.greatest(zero, net)))
        .otherwise(F.when(other < 0, change).otherwise(F.least(zero, net)))
    )
    own = F.when(is_new | is_lost, zero).otherwise(own)
    moved = F.when(is_new | is_lost, zero).otherwise(change - own)
    return {
        "new": F.when(is_new, focus_p2).otherwise(zero),
        "lost": F.when(is_lost, -focus_p1).otherwise(zero),
        "increased_focus": F.greatest(own, zero),
        "decreased_focus": F.least(own, zero),
        "switch_from_comparison": F.greatest(moved, zero),
        "switch_to_comparison": F.least(moved, zero),
    }


def _masked(df: Any, masks: list[Any]) -> tuple[Any, list[Any]]:
    """Masks of a pandas frame (a boolean for each row) as columns of it; conditions stay as they are."""
    lists = [i for i, m in enumerate(masks) if not isinstance(m, (Column, str))]
    if not lists:
        return df, masks
    if not hasattr(df, "iloc"):
        raise TypeError("masks of rows go with a pandas frame; conditions go with any table")
    if any(len(masks[i]) != len(df) for i in lists):
        raise ValueError(f"a mask needs a value for each of the {len(df)} rows")
    named = {i: f"__mask_{i}" for i in lists}
    return df.assign(**{n: [bool(x) for x in masks[i]] for i, n in named.items()}), [F.col(named[i]) if i in named else m for i, m in enumerate(masks)]


class GainLoss(Result):
    """``table`` by customer (and group), ``summary`` over all or by group.

    Periods and groups are conditions on rows, or for a pandas frame masks of its rows; customers all of whose values are 0 are left out,
    as are rows without a customer or group.  Overlapping conditions are a ValueError unless
    ``check_overlap`` is off (the check is a small job).
    """

    def __init__(
        self,
        df: Any,
        p1: Column | str | Any,
        p2: Column | str | Any,
        focus: Column | str | Any,
        focus_group_name: str,
        comparison: Column | str | Any,
        comparison_group_name: str,
        group_col: str | None = None,
        value_col: str | None = None,
        agg_func: str = "sum",
        check_overlap: bool = True,
    ) -> None:
        df, (p1, p2, focus, comparison) = _masked(df, [p1, p2, focus, comparison])
        df, customer, value = as_table(df), column("customer_id"), value_col or column("unit_spend")
        keys = [*([group_col] if group_col else []), customer]
        validate_columns(df, [value, *keys])
        p1, p2, focus, comparison = (F.expr(c) if isinstance(c, str) else c for c in (p1, p2, focus, comparison))
        if check_overlap:
            for what, both in (("periods", p1 & p2), ("groups", focus & comparison)):
                if df.filter(both).limit(1).count():
                    raise ValueError(f"The {what} overlap")
        self.group_col = group_col
        self.focus_group_name, self.comparison_group_name = focus_group_name, comparison_group_name
        cells = {f"{g}_{p}": where & when for p, when in (("p1", p1), ("p2", p2)) for g, where in (("focus", focus), ("comparison", comparison), ("total", F.lit(True)))}
        rows = df.filter(p1 | p2)
        for k in keys:
            rows = rows.filter(F.col(k).isNotNull())
        by = rows.groupBy(*keys).agg(*[F.coalesce(aggregate(agg_func, value, where), F.lit(0)).cast("double").alias(n) for n, where in cells.items()])
        some = F.lit(False)
        for n in cells:
            some = some | (F.col(n) != 0)
        by = by.filter(some).withColumns({f"{g}_diff": F.col(f"{g}_p2") - F.col(f"{g}_p1") for g in ("focus", "comparison", "total")})
        parts = customer_parts(*(F.col(c) for c in ("focus_p1", "comparison_p1", "focus_p2", "comparison_p2")))
        self.table, self.index = by.withColumns(parts), keys
        numbers = [c for c in self.table.columns if c not in keys]
        sums = [F.sum(c).alias(c) for c in numbers]
        self.summary: DataFrame = self.table.groupBy(group_col).agg(*sums) if group_col else self.table.agg(*sums)

    def plot(self, ax: Any = None, **kwargs: Any) -> Any:
        """Bars of the summary's six parts (see ``charts.plots.gain_loss_plot``)."""
        from ..charts.plots import gain_loss_plot

        return gain_loss_plot(self.summary, self.focus_group_name, self.comparison_group_name, self.group_col, ax=ax, **kwargs)

    @functools.cached_property
    def gain_loss_df(self) -> Any:
        return self.df

    @functools.cached_property
    def gain_loss_table_df(self) -> Any:
        return self.summary.toPandas()
