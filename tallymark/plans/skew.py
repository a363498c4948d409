"""Joins in which any share of the rows may name one key.

Adaptive execution splits a skewed partition of a join by itself where it may; these take the hot keys apart
beforehand, where it may not or where a key's rows are wide.
"""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SHARES = 2048  # keys with more than this part of all rows are joined in parts


def hot_keys(sizes: DataFrame, key: str, total: int, least: int = 1) -> list[tuple[Any, int]]:
    """Keys with more than 1/SHARES of ``total`` rows, and more than ``least``, with the number of parts to
    cut them into.  ``sizes`` has ``key, n``, the rows per key (repeated rows do no harm), so there are
    fewer than SHARES."""
    share = max(least, -(-total // SHARES))
    found = sizes.filter((F.col("n") > share) & F.col(key).isNotNull())
    rows = found.select(key, F.ceil(F.col("n") / share)).distinct().collect()
    return [(k.asDict() if hasattr(k, "asDict") else k, n) for k, n in rows]


def spread_join(left: DataFrame, right: DataFrame, key: str, salt: str, hot: list[tuple[Any, int]], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` by ``key``, hot keys (:func:`hot_keys`) of left in parts: left's rows are
    dealt to these by the hash of ``salt``, right's are copied to them, which for a right side of one row
    per key is SHARES copies more in all."""
    if not hot:
        return left.join(right, key, how)
    kind = to_arrow_type(left.schema[key].dataType)
    listed = pa.table({key: pa.array([k for k, _ in hot], kind), "__shares": pa.array([n for _, n in hot], pa.int64())})
    parts = F.broadcast(left.sparkSession.createDataFrame(listed))
    shares = F.coalesce("__shares", F.lit(1).cast("long"))
    cut = left.join(parts, key, "left").withColumn("__part", F.pmod(F.xxhash64(salt), shares)).drop("__shares")
    copied = right.join(parts, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("__shares")
    return cut.join(copied, [key, "__part"], how).drop("__part")
