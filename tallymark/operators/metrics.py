"""Distribution metrics: commodity volume and the share of stores."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from ..functions import ratio_metric
from ..options import column
from ..sources import as_table, validate_columns
from .base import Result, listed


class Acv(Result):
    """All-commodity volume: summed spend over a scale, overall or by groups."""

    def __init__(self, df: Any, *, group_col: str | list[str] | None = None, acv_scale_factor: float = 1_000_000) -> None:
        df, groups, spend = as_table(df), listed(group_col), column("unit_spend")
        if acv_scale_factor <= 0:
            raise ValueError("acv_scale_factor must be above 0")
        validate_columns(df, [spend, *groups])
        acv = (F.sum(spend) / F.lit(float(acv_scale_factor))).alias("acv")
        self.table = df.groupBy(*groups).agg(acv) if groups else df.agg(acv)


class PctOfStores(Result):
    """Stores that sell a product, as a number and a percentage of all stores (or of the group's)."""

    def __init__(self, df: Any, *, product_col: str | None = None, group_col: str | list[str] | None = None, within_group: bool = False) -> None:
        df, groups, store = as_table(df), listed(group_col), column("store_id")
        product = product_col or column("product_id")
        if product in groups:
            raise ValueError(f"product_col {product} must not also appear in group_col")
        validate_columns(df, [store, product, *groups])
        sold = df.select(store, product, *groups).distinct()
        counts = sold.groupBy(product, *groups).agg(F.count(store).alias(column("agg.store_id")))
        if within_group and groups:
            of = sold.groupBy(*groups).agg(F.count_distinct(store).alias("__all")).select(*[F.col(g).alias(f"__{g}") for g in groups], "__all")
            same = F.lit(True)
            for g in groups:
                same = same & (F.col(g) == F.col(f"__{g}"))
            counts = counts.join(of, same).drop(*[f"__{g}" for g in groups])
        else:
            counts = counts.crossJoin(F.broadcast(sold.agg(F.count_distinct(store).alias("__all"))))
        share = ratio_metric(column("agg.store_id"), "__all").alias(column("agg.store_id", "percent"))
        self.table = counts.select(product, *groups, column("agg.store_id"), share)
