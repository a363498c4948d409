"""Ranks over a whole table without sending it to one task.

An ordered window without partition columns moves every row to a single task.  Here rows are dealt
into ranges of the order key instead: the bounds come from a sample of fixed size that is chosen by
hash (so every evaluation of the plan sees the same bounds), each range is ranked by itself, and a range
begins where the sizes of the ranges before it end.  The number of ranges follows the number of rows.
Keys keep their own type, so dates, strings, decimals and long numbers order as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .skew import hot_keys, spread_join

ROWS = 1 << 16  # rows of a range, on average
RANGES = 1024  # ranges at most
SAMPLE = 16 * RANGES  # rows that the bounds of ranges are taken from


@dataclass(frozen=True)
class Order:
    """One order of a table: by value, nulls last (NaN is the largest number), then by tie, rising.

    With ``shared`` equal values share the first of their places (a rank)."""

    value: Column
    out: str
    descending: bool = False
    tie: Column | None = None
    shared: bool = False

    def _first(self, a: Column, b: Column) -> Column:
        """-1, 0 or 1 as one key (``value``, ``tie``) comes before, with or behind another."""
        one, two = a["value"], b["value"]
        up, down = (1, -1) if self.descending else (-1, 1)
        by_value = F.when(one.eqNullSafe(two), 0).when(two.isNull(), -1).when(one.isNull(), 1).when(one < two, up).otherwise(down)
        if self.tie is None or self.shared:
            return by_value
        by_tie = F.when(a["tie"].eqNullSafe(b["tie"]), 0).when(b["tie"].isNull(), -1).when(a["tie"].isNull(), 1).when(a["tie"] < b["tie"], -1).otherwise(1)
        return F.when(by_value != 0, by_value).otherwise(by_tie)

    def _sorted(self, key: str) -> list[Column]:
        value, tie = F.col(f"{key}.value"), F.col(f"{key}.tie")
        out = [value.desc_nulls_last() if self.descending else value.asc_nulls_last()]
        return out if self.tie is None or self.shared else [*out, tie.asc_nulls_last()]


def _range_of(order: Order, key: Column, name: str, step: int) -> Column:
    """How many bounds (``name``, sorted) the key has reached, looked up among every ``step``-th first."""

    def reached(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda b: order._first(b, key) <= 0))

    if step == 1:
        return reached(F.col(name))
    begin = step * reached(F.transform(F.sequence(F.lit(step - 1), F.size(name) - 1, F.lit(step)), lambda i: F.get(name, i)))
    return begin + reached(F.slice(name, begin + 1, F.lit(step)))


def positions(data: DataFrame, orders: list[Order], count: str = "n", ranges: int | None = None) -> DataFrame:
    """Add each row's 1-based place in every order, and the number of rows.

    The input is computed once: it is written to the shared folder with its keys, and counted, before
    the plan of the result reads it.  All orders share one sample and one count of the ranges.
    """
    columns = data.columns
    keys = {f"__key{i}": F.struct(o.value.alias("value"), (o.tie if o.tie is not None else F.lit(0)).alias("tie")) for i, o in enumerate(orders)}
    rows = written(data.withColumns(keys | {"__spin": F.monotonically_increasing_id()}), "ranks")
    n = rows.count()
    parts = ranges or min(RANGES, max(1, -(-n // ROWS)))
    shown = [F.col(f"`{c}`") for c in columns]
    if parts == 1:
        out = rows.withColumns({o.out: (F.rank() if o.shared else F.row_number()).over(Window.partitionBy(F.lit(0)).orderBy(*o._sorted(f"__key{i}"))).cast("long") for i, o in enumerate(orders)})
        return out.select(*shown, F.lit(n).cast("long").alias(count), *[o.out for o in orders])
    chosen = rows.select(*keys).orderBy(F.xxhash64(*keys)).limit(min(SAMPLE, 64 * parts))
    sampled = chosen.agg(*[F.collect_list(k).alias(k) for k in keys])

    def cuts(order: Order, key: str) -> Column:
        listed = F.array_sort(key, order._first)
        return F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get(listed, (i * F.size(listed) / parts).cast("int")))

    bounds = F.broadcast(sampled.select([cuts(o, k).alias(f"__b{i}") for i, (o, k) in enumerate(zip(orders, keys, strict=True))]))
    step = max(1, int((parts - 1) ** 0.5))
    alone = [i for i, o in enumerate(orders) if not o.shared]
    out = rows
    if alone:
        dealt = rows.crossJoin(bounds)
        # a range's code holds the order's number, so one count serves all orders
        dealt = dealt.withColumns({f"__r{i}": _range_of(orders[i], F.col(f"__key{i}"), f"__b{i}", step) + i * (parts + 1) for i in alone})
        dealt = dealt.drop(*[f"__b{i}" for i in range(len(orders))])
        sizes = dealt.select(F.explode(F.array(*[F.col(f"__r{i}") for i in alone])).alias("r")).groupBy("r").agg(F.count("*").alias("n"))
        out = dealt.crossJoin(F.broadcast(_starts(sizes, parts)))
        for i in alone:
            window = Window.partitionBy(f"__r{i}").orderBy(*orders[i]._sorted(f"__key{i}"))
            out = out.withColumn(orders[i].out, (F.element_at("__starts", F.col(f"__r{i}")) + F.row_number().over(window)).cast("long"))
        out = out.drop("__starts")
    for i, o in enumerate(orders):
        if o.shared:
            # equal values share a place, so values are placed, each once, and rows take their value's:
            # a value that many rows hold is one row in its range, and joined in parts
            values = written(rows.groupBy(f"__key{i}").agg(F.count("*").alias("n")), "values")
            ranged = values.crossJoin(bounds).withColumn("r", _range_of(o, F.col(f"__key{i}"), f"__b{i}", step))
            starts = _starts(ranged.groupBy("r").agg(F.sum("n").alias("n")), parts)
            before = F.sum("n").over(Window.partitionBy("r").orderBy(*o._sorted(f"__key{i}"))) - F.col("n")
            placed = ranged.crossJoin(F.broadcast(starts)).select(f"__key{i}", (F.element_at("__starts", F.col("r")) + before + 1).cast("long").alias(o.out))
            out = spread_join(out, placed, f"__key{i}", "__spin", hot_keys(values, f"__key{i}", n, least=ROWS))
    return out.select(*shown, F.lit(n).cast("long").alias(count), *[o.out for o in orders])


def _starts(sizes: DataFrame, parts: int) -> DataFrame:
    """One row with a map from a range's code to the number of rows in the ranges before it (``r, n``)."""
    per_order = Window.partitionBy(F.floor(F.col("r") / (parts + 1))).orderBy("r")  # a row per range and order
    begun = sizes.select("r", (F.sum("n").over(per_order) - F.col("n")).alias("start"))
    return begun.agg(F.map_from_entries(F.collect_list(F.struct("r", "start"))).alias("__starts"))


def percent_rank_of(position: Column, count: Column) -> Column:
    """percent_rank from a place among ``count`` rows without ties."""
    return F.when(count > 1, (position - 1) / (count - 1)).otherwise(F.lit(0.0))


def ntile_of(position: Column, count: Column, tiles: int) -> Column:
    """0-based ntile from a place among ``count`` rows."""
    small, larger, at = F.floor(count / tiles), count % tiles, position - 1
    edge = larger * (small + 1)
    return F.when(at < edge, F.floor(at / (small + 1))).otherwise(larger + F.floor((at - edge) / F.greatest(small, F.lit(1)))).cast("int")
