"""How often customers buy, how long they wait, and when they stay away."""

from __future__ import annotations

import functools
import operator
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..options import column
from ..sources import as_table, validate_columns
from .base import Result

_COMPARE = {
    "less_than": operator.lt, "less_than_equal_to": operator.le, "equal_to": operator.eq,
    "not_equal_to": operator.ne, "greater_than": operator.gt, "greater_than_equal_to": operator.ge,
}


class _PerCustomer(Result):
    value: str

    def percentile_table(self, *shares: float) -> DataFrame:
        """``share, value`` by linear interpolation."""
        at = F.percentile(self.value, F.array(*[F.lit(float(s)) for s in shares]))
        return self.table.agg(at.alias("v")).select(F.explode(F.arrays_zip(F.array(*[F.lit(float(s)) for s in shares]).alias("share"), F.col("v").alias("value"))).alias("r")).select("r.*")

    def purchases_percentile(self, percentile: float = 0.5) -> float:
        return self.percentile_table(percentile).head()["value"]


class PurchasesPerCustomer(_PerCustomer):
    """Number of transactions of each customer (rows without a customer are left out)."""

    def __init__(self, df: Any) -> None:
        df, customer, trip = as_table(df), column("customer_id"), column("transaction_id")
        validate_columns(df, [customer, trip])
        self.value, self.index = column("agg.transaction_id"), [customer]
        self.table = df.filter(F.col(customer).isNotNull()).groupBy(customer).agg(F.count_distinct(trip).alias(self.value))

    def share_table(self, n: int, comparison: str = "less_than_equal_to") -> DataFrame:
        """The share of customers whose number compares with ``n``."""
        if comparison not in _COMPARE:
            raise ValueError(f"comparison must be one of {sorted(_COMPARE)}")
        return self.table.agg(F.avg(F.when(_COMPARE[comparison](F.col(self.value), F.lit(n)), 1.0).otherwise(0.0)).alias("share"))

    def find_purchase_percentile(self, number_of_purchases: int, comparison: str = "less_than_equal_to") -> float:
        return self.share_table(number_of_purchases, comparison).head()["share"]


class DaysBetweenPurchases(_PerCustomer):
    """Mean days between a customer's purchase days: (last - first) / (days - 1)."""

    def __init__(self, df: Any) -> None:
        df, customer, date = as_table(df), column("customer_id"), column("transaction_date")
        validate_columns(df, [customer, date])
        self.value, self.index = "diff", [customer]
        day = F.col(date).cast("date")
        days = df.filter(F.col(customer).isNotNull()).groupBy(customer).agg(F.count_distinct(day).alias("n"), F.min(day).alias("a"), F.max(day).alias("b"))
        self.table = days.filter("n > 1").select(customer, (F.datediff("b", "a") / (F.col("n") - 1)).alias("diff"))


class TransactionChurn(Result):
    """By number of purchase days: customers who came again and who did not.

    A day within ``churn_period`` days of the last day of all is too young to tell.  ``retained``
    and ``churned`` are null where there are none, and ``churned_pct`` is null with ``churned``.
    """

    def __init__(self, df: Any, churn_period: float) -> None:
        df, customer, date = as_table(df), column("customer_id"), column("transaction_date")
        validate_columns(df, [customer, date])
        known = df.filter(F.col(customer).isNotNull())
        days = known.select(F.col(customer).alias("c"), F.col(date).cast("date").alias("d")).distinct()
        window = Window.partitionBy("c").orderBy("d")
        visits = days.select("d", F.row_number().over(window).alias("transaction_number"), F.lead("d").over(window).isNull().alias("last"))
        newest = days.agg(F.max("d").alias("newest"))
        old = visits.crossJoin(F.broadcast(newest)).filter(F.datediff("newest", "d") > churn_period)
        churned, retained = F.nullif(F.count_if("last"), F.lit(0)), F.nullif(F.count_if(~F.col("last")), F.lit(0))
        by = old.groupBy("transaction_number").agg(retained.alias("retained"), churned.alias("churned"))
        share = F.col("churned") / (F.coalesce("retained", F.lit(0)) + F.col("churned"))
        self.table, self.index = by.withColumn("churned_pct", share), ["transaction_number"]
        self.customers = known.agg(F.count_distinct(customer).alias("n_unique_customers"))

    @functools.cached_property
    def n_unique_customers(self) -> int:
        return self.customers.head()[0]

    def cumulative(self) -> DataFrame:
        """Share of all customers lost up to each number (numbers are few: one row each)."""
        running = F.sum(F.coalesce("churned", F.lit(0))).over(Window.orderBy("transaction_number").rowsBetween(Window.unboundedPreceding, 0))
        return self.table.crossJoin(F.broadcast(self.customers)).select("transaction_number", (running / F.col("n_unique_customers")).alias("cumulative_churn"))
