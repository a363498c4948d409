"""Overlap of two or three groups of purchases."""

from __future__ import annotations

import functools
from typing import Any

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import aggregate
from ..options import column
from ..sources import as_table, validate_columns
from .base import Result


class CrossShop(Result):
    """``table``: per customer flags ``group_1, group_2[, group_3]``, ``groups`` (their array),
    ``group_labels`` and the value; ``summary``: value and share of each combination.

    A flag is the largest of 0 and 1 over the customer's rows, null where all its values are null.
    """

    def __init__(
        self,
        df: Any,
        group_1_col: str,
        group_1_val: Any,
        group_2_val: Any,
        group_2_col: str | None = None,
        group_3_col: str | None = None,
        group_3_val: Any = None,
        labels: list[str] | None = None,
        group_col: str | None = None,
        value_col: str | None = None,
        agg_func: str = "sum",
    ) -> None:
        df, key, value = as_table(df), group_col or column("customer_id"), value_col or column("unit_spend")
        if (group_3_col is None) != (group_3_val is None):
            raise ValueError("group_3_col and group_3_val go together")
        specs = [(group_1_col, group_1_val), (group_2_col or group_1_col, group_2_val)] + ([(group_3_col, group_3_val)] if group_3_col else [])
        if labels is not None and len(labels) != len(specs):
            raise ValueError(f"labels must have {len(specs)} entries")
        validate_columns(df, [key, value, *[c for c, _ in specs]])
        names, labels = [f"group_{i}" for i in range(1, len(specs) + 1)], labels or ["A", "B", "C"][: len(specs)]
        self.labels = labels
        flags = [F.max((F.col(c) == F.lit(v)).cast("int")).alias(n) for n, (c, v) in zip(names, specs, strict=True)]
        by_key = df.groupBy(key).agg(*flags, aggregate(agg_func, value).alias("__value"))
        parts = F.filter(F.array(*[F.when(F.col(n) == 1, F.lit(t)) for n, t in zip(names, labels, strict=True)]), lambda x: x.isNotNull())
        label = F.when(F.size(parts) == 0, F.lit("No Groups")).otherwise(F.array_join(parts, ", "))
        shown = [F.col(key), *names, F.array(*names).alias("groups"), label.alias("group_labels")]
        out = value if value != key else f"{value}_value"
        self.table, self.index = by_key.select(*shown, F.col("__value").alias(out)), [key]
        summed = self.table.groupBy("groups", "group_labels").agg(F.sum(out).alias(out))
        self.summary = summed.withColumn("percent", F.col(out) / F.nullif(F.sum(out).over(Window.partitionBy()), F.lit(0)))

    def plot(self, ax: Any = None, **kwargs: Any) -> Any:
        """The summary as overlapping circles (see ``charts.plots.venn_plot``)."""
        from ..charts.plots import venn_plot

        return venn_plot(self.summary, self.labels, ax=ax, **kwargs)

    @functools.cached_property
    def cross_shop_df(self) -> Any:
        return self.df

    @functools.cached_property
    def cross_shop_table_df(self) -> Any:
        return self.summary.toPandas()
