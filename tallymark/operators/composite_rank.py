"""Several ranks put into one."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.ranking import Order, positions
from ..sources import as_table, validate_columns
from .base import Result, listed

_ORDERS = {"asc": False, "ascending": False, "desc": True, "descending": True}


class CompositeRank(Result):
    """Rank rows by each column, then combine the ranks (mean, sum, min or max).

    ``rank_cols`` holds names or (name, order) pairs; ranks start at 1, within ``group_col`` if
    given; values order by their own type, nulls last and NaN as the largest number.  With ``ignore_ties`` equal values get different ranks, in the order of all columns.
    """

    def __init__(self, df: Any, rank_cols: list[Any], agg_func: str, ignore_ties: bool = False, group_col: str | list[str] | None = None) -> None:
        df, groups, func = as_table(df), listed(group_col), str(agg_func).lower()
        if func not in ("mean", "sum", "min", "max"):
            raise ValueError(f"Aggregation function {agg_func} not supported; choose mean, sum, min or max")
        validate_columns(df, groups)
        named = []
        for spec in rank_cols:
            if isinstance(spec, (tuple, list)) and len(spec) != 2:
                raise ValueError("a rank column is a name or a pair of name and order")
            name, order = (spec, "asc") if isinstance(spec, str) else spec
            if str(order).lower() not in _ORDERS:
                raise ValueError(f"Sort order must be one of {sorted(_ORDERS)}, not {order}")
            validate_columns(df, [name])
            named.append((name, _ORDERS[str(order).lower()]))
        if not named:
            raise ValueError("rank_cols must not be empty")
        columns, orders = df.columns, []
        for name, falls in named:
            out, own = f"{name}_rank", F.col(f"`{name}`")
            rest = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
            if groups:
                by = own.desc_nulls_last() if falls else own.asc_nulls_last()
                window = Window.partitionBy(*groups).orderBy(by, rest) if ignore_ties else Window.partitionBy(*groups).orderBy(by)
                df = df.withColumn(out, (F.row_number() if ignore_ties else F.rank()).over(window).cast("long"))
            else:
                orders.append(Order(own, out, falls, rest if ignore_ties else None, shared=not ignore_ties))
        ranks = [F.col(f"`{name}_rank`") for name, _ in named]
        total = ranks[0]
        for rank in ranks[1:]:
            total = total + rank
        extremes = {"min": F.least, "max": F.greatest}
        combined = total / len(ranks) if func == "mean" else total if func == "sum" else extremes[func](*ranks) if len(ranks) > 1 else ranks[0]
        shown = [*[F.col(f"`{c}`") for c in columns], *[F.col(f"`{name}_rank`") for name, _ in named], combined.alias("composite_rank")]
        self._make = lambda: (positions(df, orders, "__n") if orders else df).select(*shown)
