"""Labels by conditions, of rows and of groups."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import column
from ..sources import as_table, validate_columns


def first_match(conditions: dict[str, Column]) -> tuple[Column, Column]:
    """Whether any condition holds, and the name of the first that does."""
    if not conditions:
        raise ValueError("at least one condition is needed")
    any_of, label = F.lit(False), None
    for name, condition in conditions.items():
        any_of = any_of | condition
        label = F.when(condition, F.lit(name)) if label is None else label.when(condition, F.lit(name))
    return any_of, label


def filter_and_label_by_condition(table: Any, conditions: dict[str, Column], label_col: str = "label") -> DataFrame:
    """Rows that satisfy a condition, labelled by the first they satisfy."""
    any_of, label = first_match(conditions)
    return as_table(table).filter(any_of).withColumn(label_col, label)


def label_by_condition(
    table: Any,
    condition: Column,
    label_col: str | None = None,
    return_col: str = "label_name",
    labeling_strategy: str = "binary",
    contains_label: str = "contains",
    not_contains_label: str = "not_contains",
    mixed_label: str = "mixed",
) -> DataFrame:
    """Label each value of ``label_col`` by its rows: any of them satisfies the condition, or
    (extended) all, some or none do.  A null condition counts as not satisfied."""
    table, key = as_table(table), label_col or column("transaction_id")
    if labeling_strategy not in ("binary", "extended"):
        raise ValueError(f"labeling_strategy must be binary or extended, not {labeling_strategy}")
    validate_columns(table, [key])
    flag = F.when(condition, 1).otherwise(0)
    by = table.groupBy(key).agg(F.max(flag).alias("most"), F.min(flag).alias("least"))
    label = F.when(F.col("most") == 0, F.lit(not_contains_label))
    if labeling_strategy == "extended":
        label = label.when(F.col("least") == 0, F.lit(mixed_label))
    return by.select(key, label.otherwise(F.lit(contains_label)).alias(return_col))
