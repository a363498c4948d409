"""Shuffles that follow the size of the input, and counts of pairs."""

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallymark import catalog
from tallymark import operators as ops
from tallymark.plans import pairs as pairs_plan
from tallymark.plans import spread
from tallymark.sources import transactions

from test_support import test_query_equals_its_sql as equals_sql


@pytest.fixture
def many(monkeypatch):
    """Small tables ask for many partitions."""
    monkeypatch.setattr(spread, "PART", 1 << 12)


def tasks(df):
    return df.rdd.getNumPartitions()


def test_parts_follow_the_input(spark, small, monkeypatch):
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    assert spread.parts(lines) is None and spread.parts(spark.range(10)) is None
    monkeypatch.setattr(spread, "PART", 1 << 12)
    once = spread.parts(lines)
    assert once > 20 and spread.parts(lines, lines) in (2 * once, 2 * once - 1)
    assert tasks(transactions(spark, small)) > 20


@pytest.fixture
def wide(spark):
    """A session with more partitions than the input asks for."""
    names = {"spark.sql.shuffle.partitions": "500", "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def test_parts_where_the_session_has_more(wide, small, many):
    """Adaptive execution merges the session's partitions, down to the cores: only where it may not they are kept."""
    lines = wide.read.parquet(f"{small}/lineitem.parquet")
    assert 20 < spread.parts(lines) < 500
    wide.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert spread.parts(lines) is None


@pytest.mark.parametrize("name", ["assoc_target", "assoc_sparse", "composite_rank_mean"])
def test_wide_session_is_not_merged(wide, small, many, name):
    equals_sql(wide, small, name)
    made = catalog.queries()[name](wide, small) if name.startswith("assoc") else catalog._products(wide, small)
    assert 20 < tasks(made) < 500


@pytest.mark.parametrize("name", ["cdh_pairs", "cdh_met_pairs", "cdh_distances"])
def test_hierarchy_in_many_partitions(spark, small, many, name):
    equals_sql(spark, small, name)


def test_hierarchy_pairs_are_spread(spark, small, many):
    assert tasks(catalog.queries()["cdh_pairs"](spark, small)) > 20


def test_hierarchy_without_transactions(spark):
    """Rows without a transaction are never together; a transaction of two customers holds both."""
    rows = [(1, None, "a"), (1, None, "b"), (1, 1, "c"), (1, 1, "c"), (2, 2, "a"), (3, 2, "a"), (2, 3, "d"), (4, 4, "a"), (4, 4, "b"), (4, 5, "c")]
    df = spark.createDataFrame(rows, "customer_id long, transaction_id long, p string")
    got = ops.CustomerDecisionHierarchy(df, "p").pairs
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "b"), (1, "c"), (2, "d"), (4, "c")]


@pytest.mark.parametrize("name", ["assoc_all", "assoc_target", "assoc_sparse"])
def test_associations_in_many_partitions(spark, small, many, name):
    equals_sql(spark, small, name)
    assert tasks(catalog.queries()[name](spark, small)) > 20


@pytest.mark.parametrize("name", ["composite_rank_mean", "composite_rank_grouped"])
def test_ranked_products_in_many_partitions(spark, small, many, name):
    equals_sql(spark, small, name)
    assert tasks(catalog._products(spark, small, "brand")) > 20


@pytest.mark.parametrize("block, share", [(1000, 1 << 22), (3, 1 << 8)])
def test_pair_counts(spark, monkeypatch, block, share):
    """Lists longer than a block, hot items, and pairs that begin with an item wanted."""
    monkeypatch.setattr(pairs_plan, "BASKET", block)
    monkeypatch.setattr(pairs_plan, "PAIRS", share)
    baskets = {g: sorted({(g * k * 7 + k) % 23 for k in range(g % 11)} | ({0} if g % 3 else set())) for g in range(60)}
    rows = spark.createDataFrame([(g, i) for g, items in baskets.items() for i in items], "g long, i long").repartition(3)
    ordered = Counter(p for items in baskets.values() for p in itertools.combinations(items, 2))
    got = {(x, y): n for x, y, n in pairs_plan.pair_counts(rows, "g", "i", None).collect()}
    assert got == ordered
    wanted = Counter(p for items in baskets.values() for p in itertools.permutations(items, 2) if p[0] in (0, 5))
    found = pairs_plan.pair_counts(rows, "g", "i", None, [0, 5]).collect()
    assert {(x, y): n for x, y, n in found} == wanted and len(found) == len(wanted)
    assert pairs_plan.pair_counts(rows.filter("g < 0"), "g", "i", None).collect() == []


def test_pairs_are_shuffled_as_lists(spark, small, many):
    """No join of customers with themselves: each product's row holds the products behind it."""
    plan = ops.CustomerDecisionHierarchy(transactions(spark, small), "store_id", exclude_same_transaction_products=False)._met
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(items" in shown and "customer" not in shown.split("Aggregate")[1]


@pytest.mark.parametrize("name", ["seg_stats_extra_aggs", "seg_stats_cube_fixed", "seg_stats_unknown"])
def test_segments_in_many_partitions(spark, small, many, name):
    equals_sql(spark, small, name)


def test_median_of_sets(spark):
    """Even and odd numbers, null keys and values, a group without values, signs, zero, infinite values and NaN."""
    inf, nan = float("inf"), float("nan")
    values = {"a": [1.0, 1.0, 2.0, 900.0], "b": [-3.0, 0.0, 5e-320], "c": [None], None: [4.0, 4.5], "d": [-inf, -1e308, -1e-300, 7.0, inf, nan], "e": [nan, 1.0, nan], "f": [2.0, 2.000001, 2.000002, 2.000003]}
    rows = [(s, str(i), v) for s, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "segment_name string, transaction_id string, unit_spend double").repartition(3)
    made = ops.SegTransactionStats(df, "segment_name", grouping_sets="total", extra_aggs={"m": ("unit_spend", "median")}).table
    shown = {r["segment_name"]: r["m"] for r in made.collect()}
    want = {r["segment_name"]: r["m"] for r in df.groupBy("segment_name").agg(F.percentile("unit_spend", F.lit(0.5)).alias("m")).collect()}
    want["Total"] = df.agg(F.percentile("unit_spend", F.lit(0.5))).head()[0]
    assert {k: str(v) for k, v in shown.items()} == {k: str(v) for k, v in want.items()}
    assert "percentile(" not in made._jdf.queryExecution().optimizedPlan().toString()
