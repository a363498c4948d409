"""Cohorts: what customers of one first period do in the periods after it."""

from __future__ import annotations

import functools
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregate
from ..options import column
from ..sources import as_table, validate_columns
from .base import Result

PERIODS = ("year", "quarter", "month", "week", "day")


def _by_customer(rows: DataFrame, agg_func: str, own: bool) -> tuple[DataFrame, Column]:
    """Rows ``c, p, v`` put together by customer and period as far as the aggregate allows, so that even a
    customer with a large share of all rows has few, and the aggregate over what is left."""
    whole = aggregate(agg_func, "v")
    if agg_func in ("sum", "min", "max"):
        return rows.groupBy("c", "p").agg(whole.alias("v")), whole
    if agg_func == "count":
        return rows.groupBy("c", "p").agg(whole.alias("v")), F.sum("v")
    if agg_func == "nunique":  # a customer is in one cohort, so customers need no second look for copies
        return rows.distinct(), F.count("v") if own else whole
    return rows, whole


class CohortAnalysis(Result):
    """``table`` is long: ``min_period_shopped, period_since, period_value``, with zeros for every
    cohort and distance that nothing falls into; ``wide()`` and ``df`` have a column per distance.

    Weeks begin on Mondays, in the gap-free calendar too.  Rows without a customer or date are in
    no cohort.  With ``percentage`` a cohort's values are relative to its first period, rounded to
    2 digits, half to even.
    """

    def __init__(self, df: Any, aggregation_column: str, agg_func: str = "nunique", period: str = "month", percentage: bool = False) -> None:
        df, customer, date = as_table(df), column("customer_id"), column("transaction_date")
        if period not in PERIODS:
            raise ValueError(f"period must be one of {PERIODS}, not {period}")
        validate_columns(df, [customer, date, aggregation_column])
        rows = df.select(F.col(customer).alias("c"), F.date_trunc(period, F.col(date)).cast("date").alias("p"), F.col(f"`{aggregation_column}`").alias("v")).filter("c is not null and p is not null")
        since = F.expr(f"cast(timestampdiff({period}, cast(min_period_shopped as timestamp), cast(p as timestamp)) as int)")
        small, value = _by_customer(rows, agg_func, aggregation_column == customer)
        placed = small.withColumn("min_period_shopped", F.min("p").over(Window.partitionBy("c")))
        cells = placed.groupBy("min_period_shopped", "p").agg(value.alias("value")).select("min_period_shopped", since.alias("period_since"), "value")
        span = cells.agg(F.min("min_period_shopped").alias("a"), F.max("min_period_shopped").alias("b"), F.max("period_since").alias("m")).filter("a is not null")
        step = {"year": "interval 1 year", "quarter": "interval 3 months", "month": "interval 1 month", "week": "interval 7 days", "day": "interval 1 day"}[period]
        grid = span.select(F.explode(F.expr(f"sequence(a, b, {step})")).alias("min_period_shopped"), "m").select("min_period_shopped", F.explode(F.sequence(F.lit(0), F.col("m"))).alias("period_since"))
        filled = grid.join(cells, ["min_period_shopped", "period_since"], "left")
        if percentage:
            base = cells.filter("period_since = 0").select("min_period_shopped", F.nullif(F.col("value").cast("double"), F.lit(0.0)).alias("base"))
            filled = filled.join(base, "min_period_shopped", "left").withColumn("value", F.bround(F.col("value") / F.col("base"), 2))
        self.table = filled.select("min_period_shopped", "period_since", F.coalesce("value", F.lit(0)).alias("period_value"))

    def wide(self) -> DataFrame:
        """A row per cohort and a column per distance (their number is found by a job)."""
        last = self.table.agg(F.max("period_since").alias("m")).head()["m"]
        return self.table.groupBy("min_period_shopped").pivot("period_since", list(range((last if last is not None else -1) + 1))).agg(F.first("period_value")).orderBy("min_period_shopped")

    @functools.cached_property
    def df(self) -> Any:
        return self.wide().toPandas().set_index("min_period_shopped")
