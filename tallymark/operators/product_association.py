"""Which products are bought together."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import column
from ..plans.pairs import pair_counts
from ..plans.spread import dealt, distinct_count, keyed, parts
from ..sources import as_table, validate_columns
from ..storage import written
from .base import Result


class ProductAssociation(Result):
    """Directed pairs with ``occurrences_1, occurrences_2, cooccurrences, support, confidence, uplift``.

    The distinct items of baskets are written once, when ``table`` is first asked for.  Items under
    ``min_occurrences`` leave before they are paired (their pairs could not be results).  Every unordered pair
    is counted once and mirrored by an explode; with ``target_item`` only pairs that begin with a target are.
    """

    def __init__(
        self,
        df: Any,
        value_col: str,
        group_col: str | None = None,
        target_item: Any = None,
        min_occurrences: int = 1,
        min_cooccurrences: int = 1,
        min_support: float = 0.0,
        min_confidence: float = 0.0,
        min_uplift: float = 0.0,
    ) -> None:
        df, group = as_table(df), group_col or column("transaction_id")
        validate_columns(df, [group, value_col])
        for name, value, low, high in (("min_occurrences", min_occurrences, 1, None), ("min_cooccurrences", min_cooccurrences, 1, None), ("min_support", min_support, 0, 1), ("min_confidence", min_confidence, 0, 1), ("min_uplift", min_uplift, 0, None)):
            if value < low or (high is not None and value > high):
                raise ValueError(f"{name} must be at least {low}" + (f" and at most {high}" if high is not None else ""))
        targets = None if target_item is None else list(target_item) if isinstance(target_item, (list, tuple, set)) else [target_item]
        if targets is not None and (not targets or not all(isinstance(t, (str, int, float)) for t in targets)):
            raise ValueError("target_item must be an item or a list of items")
        def make() -> DataFrame:
            number = parts(df)
            held = df.select(F.col(group).alias("g"), F.col(value_col).alias("i")).filter("g is not null")
            pairs = written((dealt(held, number, "g", "i") if number else held).distinct(), "baskets")
            total = distinct_count(pairs, number, "g", "total")
            frequent = pairs.filter("i is not null")
            items = frequent.groupBy("i").agg(F.count("*").alias("n")).filter(F.col("n") >= min_occurrences)
            if min_occurrences > 1:
                frequent = written(frequent.join(keyed(items.select("i"), number, "i"), "i"), "frequent")
            together = pair_counts(frequent, "g", "i", number, targets).withColumnRenamed("n", "cooccurrences").filter(F.col("cooccurrences") >= min_cooccurrences)
            return self._found(together, items, total, number, value_col, targets is None, min_support, min_confidence, min_uplift)

        self._make = make

    def _found(self, together: DataFrame, items: DataFrame, total: DataFrame, number: int | None, value_col: str, mirrored: bool, min_support: float, min_confidence: float, min_uplift: float) -> DataFrame:
        side = lambda of: keyed(items.select(F.col("i").alias(of), F.col("n").alias(f"n_{of}")), number, of)
        known = together.join(side("x"), "x").join(side("y"), "y").crossJoin(F.broadcast(total))
        support = F.col("cooccurrences") / F.col("total")
        known = known.withColumn("support", support).filter(F.col("support") >= min_support)
        known = known.withColumn("uplift", F.col("support") / ((F.col("n_x") / F.col("total")) * (F.col("n_y") / F.col("total")))).filter(F.col("uplift") >= min_uplift)
        one = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(f"n_{a}").alias("n_a"), F.col(f"n_{b}").alias("n_b"))
        ways = F.array(one("x", "y"), one("y", "x")) if mirrored else F.array(one("x", "y"))
        both = known.select(F.explode(ways).alias("p"), "cooccurrences", "support", "uplift").withColumn("confidence", F.col("cooccurrences") / F.col("p.n_a")).filter(F.col("confidence") >= min_confidence)
        order = [f"{value_col}_1", f"{value_col}_2"]
        shown = both.select(
            F.col("p.a").alias(f"{value_col}_1"), F.col("p.b").alias(f"{value_col}_2"), F.col("p.n_a").alias("occurrences_1"), F.col("p.n_b").alias("occurrences_2"), "cooccurrences", "support", "confidence", "uplift"
        )
        return shown.repartitionByRange(number, *order).sortWithinPartitions(*order) if number else shown.orderBy(*order)
