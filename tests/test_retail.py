"""Retail operators on small literal tables with known results."""

import datetime
import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tallymark import operators as ops
from tallymark.functions import haversine_distance, human_number, ratio_metric
from tallymark.options import option_context
from tallymark.plans import ranking
from tallymark.plans.grouping import cube, plan, rollup


def frame(spark, columns, rows):
    return spark.createDataFrame(rows, columns)


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


SALES = [(1, 100.0, 101, "Premium", 10), (2, 200.0, 102, "Standard", 20), (3, 150.0, 103, "Premium", 15), (4, 300.0, 104, "Standard", 30), (5, 250.0, 105, "Premium", 25)]
SALES_COLUMNS = "customer_id long, unit_spend double, transaction_id long, segment_name string, unit_quantity long"


class TestSegStats:
    def test_totals(self, spark):
        table = ops.SegTransactionStats(frame(spark, SALES_COLUMNS, SALES), grouping_sets="total").table
        assert values(table, "segment_name", "spend", "transactions", "customers", "units") == [("Premium", 500.0, 3, 3, 50), ("Standard", 500.0, 2, 2, 50), ("Total", 1000.0, 5, 5, 100)]
        assert values(table, "spend_per_customer", "price_per_unit")[1:] == [(200.0, 10.0), (250.0, 10.0)]

    def test_zero_units_and_missing_columns(self, spark):
        rows = frame(spark, SALES_COLUMNS, [(1, 5.0, 1, "A", 1), (1, 5.0, 2, "A", -1)])
        assert values(ops.SegTransactionStats(rows, grouping_sets="total").table, "price_per_unit") == [(None,), (None,)]
        assert "customers" not in ops.SegTransactionStats(rows.drop("customer_id", "unit_quantity"), grouping_sets="total").table.columns
        with pytest.raises(ValueError, match="missing"):
            ops.SegTransactionStats(rows.drop("unit_spend"), grouping_sets="total")

    def test_null_segment_is_not_the_total(self, spark):
        rows = frame(spark, SALES_COLUMNS, [(1, 5.0, 1, None, 1), (2, 7.0, 2, "A", 1)])
        assert values(ops.SegTransactionStats(rows, grouping_sets="total").table, "segment_name", "spend") == [("A", 7.0), ("Total", 12.0), (None, 5.0)]

    def test_no_rows(self, spark):
        empty = frame(spark, SALES_COLUMNS, SALES).limit(0)
        assert values(ops.SegTransactionStats(empty, grouping_sets="total").table, "segment_name", "spend", "transactions") == [("Total", None, 0)]
        assert ops.SegTransactionStats(empty, grouping_sets=[("segment_name",)]).table.count() == 0

    def test_unknown_customers(self, spark):
        rows = frame(spark, SALES_COLUMNS, [(-1, 5.0, 1, "A", 1), (2, 7.0, 2, "A", 2), (None, 1.0, 3, "A", 1)])
        got = ops.SegTransactionStats(rows, grouping_sets=[("segment_name",)], unknown_customer_value=-1).table.head()
        assert (got["spend"], got["spend_unknown"], got["spend_total"], got["transactions_total"], got["customers"]) == (7.0, 5.0, 13.0, 3, 1)
        assert got["spend_per_transaction_unknown"] == 5.0

    def test_labels_of_other_types(self, spark):
        rows = frame(spark, "transaction_id long, unit_spend double, kind string, product long", [(1, 2.0, "x", 7)])
        got = ops.SegTransactionStats(rows, ["kind", "product"], grouping_sets="rollup", rollup_value=["ALL", 0]).table
        assert values(got, "kind", "product") == [("ALL", 0), ("x", 0), ("x", 7)]
        with pytest.raises(ValueError):
            ops.SegTransactionStats(rows, ["kind", "product"], grouping_sets="rollup", rollup_value=["ALL"])

    def test_extra_aggregates_and_options(self, spark):
        rows = frame(spark, SALES_COLUMNS, SALES).withColumnRenamed("unit_spend", "money")
        with option_context("column.unit_spend", "money", "column.agg.unit_spend", "turnover"):
            got = ops.SegTransactionStats(rows, grouping_sets="total", extra_aggs={"most": ("unit_quantity", "max")}).table
        assert values(got, "segment_name", "turnover", "most") == [("Premium", 500.0, 25), ("Standard", 500.0, 30), ("Total", 1000.0, 30)]
        with pytest.raises(ValueError):
            ops.SegTransactionStats(frame(spark, SALES_COLUMNS, SALES), grouping_sets="total", extra_aggs={"x": ("unit_quantity", "nonsense")})

    def test_sets(self):
        assert cube("a", "b") == [("a", "b"), ("a",), ("b",), ()]
        assert rollup("a", "b") == [("a", "b"), ("a",), ()]
        assert plan(["a", "b", "c"], [(cube("a", "b"), "c")]) == [("a", "b", "c"), ("a", "c"), ("b", "c"), ("c",)]
        assert plan(["a", "b"], None, True, True) == [("a", "b"), ("a",), ("b",), ()]
        assert plan(["a", "b"], [("a", "b"), ("b", "a")]) == [("a", "b")]
        for wrong, error in (([], ValueError), ([("z",)], ValueError), ([("a",)], ValueError), ([(1,)], TypeError), ([(cube("a"), rollup("b"))], ValueError), ([([],)], ValueError), (5, TypeError), ("none", ValueError)):
            with pytest.raises(error):
                plan(["a", "b"], wrong)
        with pytest.raises(ValueError):
            plan(["a"], "total", True)
        with pytest.raises(ValueError):
            cube()
        with pytest.raises(TypeError):
            rollup(1)
        with pytest.warns(UserWarning):
            cube(*"abcdefg")


class TestSegmentation:
    def test_hml(self, spark):
        rows = frame(spark, "customer_id long, unit_spend double", [(1, 1000.0), (2, 200.0), (3, 0.0), (4, 500.0), (5, 300.0)])
        assert values(ops.HMLSegmentation(rows).table, "customer_id", "segment_name") == [(1, "Heavy"), (2, "Light"), (3, "Zero"), (4, "Medium"), (5, "Light")]
        assert len(ops.HMLSegmentation(rows, zero_value_customers="exclude").df) == 4
        assert ops.HMLSegmentation(rows, zero_value_customers="include_with_light").df.loc[3, "segment_name"] == "Light"

    def test_threshold(self, spark):
        ties = frame(spark, "customer_id long, unit_spend double", list(zip(range(101, 109), [100.0] * 3 + [200.0] * 2 + [300.0] * 3, strict=True)))
        got = dict(values(ops.ThresholdSegmentation(ties, [0.33, 0.66, 1], ["Low", "Medium", "High"]).table, "customer_id", "segment_name"))
        assert got == {101: "Low", 102: "Low", 103: "Low", 104: "Medium", 105: "Medium", 106: "High", 107: "High", 108: "High"}
        for wrong in ({"thresholds": [0.5, 0.5], "segments": ["a", "b"]}, {"thresholds": [0.5], "segments": ["a", "b"]}):
            with pytest.raises(ValueError):
                ops.ThresholdSegmentation(ties, **wrong)

    @pytest.mark.parametrize("rows_of_range", [300, 2_500, 1 << 16])
    def test_ranges_equal_one_window(self, spark, monkeypatch, rows_of_range):
        """Enough rows for many ranges, a few, or one, with a value that a third of them share."""
        monkeypatch.setattr(ranking, "ROWS", rows_of_range)
        rows = spark.range(20_000).select(F.col("id").alias("customer_id"), F.when(F.col("id") % 3 == 0, 0.0).when(F.col("id") % 101 == 0, None).otherwise(F.pmod(F.hash("id"), F.lit(500)).cast("double")).alias("unit_spend"))
        got = ops.ThresholdSegmentation(rows, [0.2, 0.7, 1], ["a", "b", "c"], zero_value_customers="include_with_light").table
        rows.groupBy("customer_id").agg(F.sum("unit_spend").alias("v")).createOrReplaceTempView("v")
        plain = spark.sql("select customer_id, case when p <= 0.2 then 'a' when p <= 0.7 then 'b' else 'c' end s from (select customer_id, percent_rank() over (order by v nulls last, customer_id) p from v)")
        assert got.join(plain, "customer_id").filter("segment_name != s").count() == 0
        ranked = ops.CompositeRank(rows, [("unit_spend", "desc")], "sum").table
        rows.createOrReplaceTempView("w")
        plain = spark.sql("select customer_id, rank() over (order by unit_spend desc nulls last) r from w")
        assert ranked.join(plain, "customer_id").filter("unit_spend_rank != r").count() == 0

    @pytest.mark.parametrize("rows_of_range", [50, 1 << 16])
    def test_ranks_of_any_type(self, spark, monkeypatch, rows_of_range):
        """Dates, strings, decimals, numbers beyond 2**53 and NaN, with and without groups: one window's ranks."""
        monkeypatch.setattr(ranking, "ROWS", rows_of_range)
        values_of = {
            "d": "date_add(date '2024-01-01', cast(id % 90 as int))", "s": "concat('k', cast(id * 7919 % 211 as string))", "n": "cast(id % 37 as decimal(30, 2)) / 7",
            "l": "9007199254740992 + id % 50", "x": "case when id % 17 = 0 then double('NaN') when id % 19 = 0 then null else cast(id % 23 as double) end",
        }
        rows = spark.range(700).selectExpr("id", "id % 3 as g", *[f"{e} as {c}" for c, e in values_of.items()])
        rows.createOrReplaceTempView("typed")
        for order in ("asc", "desc"):
            for groups, over in ((None, ""), ("g", "partition by g")):
                got = ops.CompositeRank(rows, [(c, order) for c in values_of], "max", group_col=groups).table
                ranks = ", ".join(f"rank() over ({over} order by {c} {order} nulls last) r_{c}" for c in values_of)
                plain = spark.sql(f"select id, {ranks} from typed")
                both = got.drop("g").join(plain, "id")
                assert both.count() == 700 and both.filter(" or ".join(f"{c}_rank != r_{c}" for c in values_of)).count() == 0
                assert both.filter(f"composite_rank != greatest({', '.join('r_' + c for c in values_of)})").count() == 0
        alone = ops.CompositeRank(rows, [("l", "desc"), "s"], "sum", ignore_ties=True).table
        assert alone.select("l_rank").distinct().count() == alone.select("s_rank").distinct().count() == 700
        assert alone.alias("a").join(alone.alias("b"), F.expr("a.l > b.l and a.l_rank > b.l_rank or a.s < b.s and a.s_rank > b.s_rank")).count() == 0

    def test_rfm(self, spark):
        days = {1: "2025-03-01", 2: "2025-02-15", 3: "2025-01-30", 4: "2025-03-10", 5: "2025-02-20"}
        spend = {1: 200.0, 2: 400.0, 3: 250.0, 4: 600.0, 5: 450.0}
        rows = frame(spark, "customer_id long, transaction_id long, unit_spend double, transaction_date string", [(c, c, spend[c], days[c]) for c in days])
        table = ops.RFMSegmentation(rows, "2025-03-17").table
        assert values(table, "customer_id", "recency_days", "r_score", "f_score", "m_score", "rfm_segment") == [(1, 16, 3, 0, 0, 300), (2, 30, 1, 1, 2, 112), (3, 46, 0, 2, 1, 21), (4, 7, 4, 3, 4, 434), (5, 25, 2, 4, 3, 243)]
        assert values(ops.RFMSegmentation(rows, "2025-03-17", min_monetary=400).table, "customer_id") == [(2,), (4,), (5,)]
        cut = ops.RFMSegmentation(rows, datetime.date(2025, 3, 17), [0.5], [0.25, 0.75], [0.5]).table
        assert values(cut, "customer_id", "r_score", "f_score") == [(1, 1, 0), (2, 0, 0), (3, 0, 1), (4, 1, 1), (5, 0, 2)]
        # cut points at both ends: every rank but the lowest is above 0, none above 1
        cut = ops.RFMSegmentation(rows, datetime.date(2025, 3, 17), [0], [0, 0.5, 1], [1]).table
        assert values(cut, "customer_id", "r_score", "f_score", "m_score") == [(1, 1, 0, 0), (2, 1, 1, 0), (3, 0, 1, 0), (4, 1, 2, 0), (5, 1, 2, 0)]
        for wrong, error in (({"r_segments": 11}, ValueError), ({"m_segments": [0.5, 0.5]}, ValueError), ({"f_segments": "x"}, TypeError), ({"min_frequency": 0}, ValueError), ({"min_monetary": "a"}, TypeError), ({"min_monetary": 5, "max_monetary": 5}, ValueError), ({"current_date": 5}, TypeError)):
            with pytest.raises(error):
                ops.RFMSegmentation(rows, **{"current_date": "2025-03-17"} | wrong)

    def test_nlr(self, spark):
        rows = [(1001, 100.0, 2023), (1001, 120.0, 2024), (1002, 200.0, 2023), (1003, 150.0, 2023), (1003, 180.0, 2024), (1004, 90.0, 2024), (1005, 0.0, 2023), (1006, 50.0, 2022)]
        table = ops.NLRSegmentation(frame(spark, "customer_id long, unit_spend double, year int", rows), "year", 2023, 2024).table
        assert values(table, "customer_id", "segment_name", "unit_spend_p1", "unit_spend_p2") == [(1001, "Repeating", 100.0, 120.0), (1002, "Lapsed", 200.0, 0.0), (1003, "Repeating", 150.0, 180.0), (1004, "New", 0.0, 90.0)]
        with pytest.raises(ValueError):
            ops.NLRSegmentation(frame(spark, "customer_id long, unit_spend double, year int", rows), "year", 2023, 2023)


class TestAnalysis:
    def test_associations(self, spark):
        baskets = [["milk", "bread", "fruit"], ["butter", "eggs", "fruit"], ["beer", "diapers"], ["milk", "bread", "butter", "eggs", "fruit"], ["bread"]]
        rows = frame(spark, "transaction_id long, product string", [(i, p) for i, b in enumerate(baskets) for p in b])
        got = {(r["product_1"], r["product_2"]): r for r in ops.ProductAssociation(rows, "product").table.collect()}
        assert len(got) == 22
        r = got["bread", "milk"]
        assert (r["occurrences_1"], r["occurrences_2"], r["cooccurrences"], r["support"]) == (3, 2, 2, 0.4)
        assert r["confidence"] == pytest.approx(2 / 3) and r["uplift"] == pytest.approx(0.4 / 0.24)
        assert values(ops.ProductAssociation(rows, "product", target_item="beer").table, "product_1", "product_2") == [("beer", "diapers")]
        assert ops.ProductAssociation(rows, "product", min_occurrences=3).table.count() == 2
        with pytest.raises(ValueError):
            ops.ProductAssociation(rows, "product", min_support=2)

    def test_cross_shop(self, spark):
        rows = frame(spark, "customer_id long, category_1_name string, unit_spend long", [(1, "Jeans", 100), (2, "Shoes", 200), (3, "Jeans", 150), (3, "Shoes", 50), (4, "Hats", 10), (5, None, 5)])
        found = ops.CrossShop(rows, "category_1_name", "Jeans", "Shoes")
        assert values(found.table, "customer_id", "group_1", "group_2", "group_labels", "unit_spend") == [(1, 1, 0, "A", 100), (2, 0, 1, "B", 200), (3, 1, 1, "A, B", 200), (4, 0, 0, "No Groups", 10), (5, None, None, "No Groups", 5)]
        assert sum(r["percent"] for r in found.summary.collect()) == pytest.approx(1)
        with pytest.raises(ValueError):
            ops.CrossShop(rows, "category_1_name", "Jeans", "Shoes", labels=["only one"])

    def test_gain_loss_rule(self, spark):
        """Focus and comparison before and after -> the six parts."""
        cases = {(0, 0, 100, 0): (100, 0, 0, 0, 0, 0), (0, 0, 100, 50): (100, 0, 0, 0, 0, 0), (100, 0, 0, 0): (0, -100, 0, 0, 0, 0), (100, 100, 0, 0): (0, -100, 0, 0, 0, 0), (100, 0, 200, 0): (0, 0, 100, 0, 0, 0), (200, 0, 100, 0): (0, 0, 0, -100, 0, 0), (0, 100, 100, 0): (0, 0, 0, 0, 100, 0), (100, 0, 0, 100): (0, 0, 0, 0, 0, -100), (0, 50, 100, 0): (0, 0, 50, 0, 50, 0), (100, 0, 0, 50): (0, 0, 0, -50, 0, -50), (100, 100, 150, 150): (0, 0, 50, 0, 0, 0), (150, 150, 100, 100): (0, 0, 0, -50, 0, 0)}
        rows = [(i, g, p, float(v)) for i, case in enumerate(cases) for (g, p), v in zip((("f", 1), ("c", 1), ("f", 2), ("c", 2)), case, strict=True) if v]
        rows += [(99, "f", 1, 5.0), (99, "f", 1, -5.0)]
        found = ops.GainLoss(frame(spark, "customer_id long, brand string, p int, unit_spend double", rows), "p = 1", "p = 2", "brand = 'f'", "F", "brand = 'c'", "C")
        got = {r["customer_id"]: tuple(r[c] for c in ("new", "lost", "increased_focus", "decreased_focus", "switch_from_comparison", "switch_to_comparison")) for r in found.table.collect()}
        assert got == dict(enumerate(cases.values()))
        total = found.summary.head()
        assert total["focus_diff"] == sum(sum(v) for v in cases.values())
        with pytest.raises(ValueError):
            ops.GainLoss(frame(spark, "customer_id long, brand string, p int, unit_spend double", rows), "p = 1", "p >= 1", "brand = 'f'", "F", "brand = 'c'", "C")

    def test_cohorts(self, spark):
        rows = [(1, "2023-01-15"), (1, "2023-02-15"), (2, "2023-01-20"), (2, "2023-03-01"), (1, "2023-03-05"), (3, "2023-05-01")]
        table = frame(spark, "customer_id long, transaction_date string", rows).withColumn("transaction_date", F.to_date("transaction_date"))
        wide = ops.CohortAnalysis(table, "customer_id").df
        assert wide.values.tolist() == [[2, 1, 2], [0, 0, 0], [0, 0, 0], [0, 0, 0], [1, 0, 0]]
        share = ops.CohortAnalysis(table, "customer_id", percentage=True).df
        assert share.iloc[0].tolist() == [1.0, 0.5, 1.0]
        assert len(ops.CohortAnalysis(table, "customer_id", period="week").df) == 17
        with pytest.raises(ValueError):
            ops.CohortAnalysis(table, "customer_id", period="decade")

    def test_customers(self, spark):
        rows = [(1, 101, "2023-01-01"), (2, 101, "2023-02-01"), (3, 101, "2023-03-02"), (4, 102, "2023-01-01"), (5, 102, "2023-02-01"), (6, 103, "2023-01-01"), (7, 103, "2023-01-15"), (8, 103, "2023-01-29"), (9, 103, "2023-02-12"), (10, 104, "2023-04-01"), (11, None, "2023-01-01")]
        table = frame(spark, "transaction_id long, customer_id long, transaction_date string", rows).withColumn("transaction_date", F.to_timestamp("transaction_date"))
        bought = ops.PurchasesPerCustomer(table)
        assert values(bought.table, "customer_id", "transactions") == [(101, 3), (102, 2), (103, 4), (104, 1)]
        assert bought.purchases_percentile(0.5) == 2.5 and bought.find_purchase_percentile(2) == 0.5
        assert values(ops.DaysBetweenPurchases(table).table, "customer_id", "diff") == [(101, 30.0), (102, 31.0), (103, 14.0)]
        churn = ops.TransactionChurn(table, 30)
        assert values(churn.table, "transaction_number", "retained", "churned") == [(1, 3, None), (2, 2, 1), (3, 1, None), (4, None, 1)]
        assert churn.n_unique_customers == 4
        with pytest.raises(ValueError):
            bought.find_purchase_percentile(2, "nearly")

    def test_revenue_tree_adds_up(self, spark):
        rows = [(1, 1, 100.0, "P1", 10, "a"), (2, 2, 200.0, "P1", 20, "a"), (1, 3, 300.0, "P2", 25, "a"), (2, 4, 400.0, "P2", 20, "a"), (3, 5, 150.0, "P2", 15, "a"), (3, 6, 50.0, "P1", 5, "b"), (4, 7, 70.0, "P2", 7, "c")]
        table = frame(spark, "customer_id long, transaction_id long, unit_spend double, period string, unit_quantity long, g string", rows)
        tree = ops.RevenueTree(table, "period", "P1", "P2", "g")
        for r in tree.table.collect():
            assert r["customers_contrib"] + r["spend_per_customer_contrib"] == pytest.approx(r["spend_diff"])
            assert r["transactions_per_customer_contrib"] + r["spend_per_transaction_contrib"] == pytest.approx(r["spend_per_customer_contrib"])
            assert r["units_per_transaction_contrib"] + r["price_per_unit_contrib"] == pytest.approx(r["spend_per_transaction_contrib"])
        assert {r["g"]: (r["spend_p1"], r["spend_p2"], r["spend_pct_diff"]) for r in tree.table.collect()}["c"] == (0.0, 70.0, None)
        nodes = ops.RevenueTree(table, "period", "P1", "P2").nodes()
        assert nodes["spend"]["children"] == ["customers", "spend_per_customer"] and nodes["spend"]["difference"] == 570.0
        assert "units_p1" not in ops.RevenueTree(table.drop("unit_quantity"), "period", "P1", "P2").table.columns

    def test_composite_rank(self, spark):
        rows = frame(spark, "product_id long, spend long, customers long", [(1, 100, 20), (2, 150, 30), (3, 100, 15), (4, 350, 25), (5, 30, 22)])
        table = ops.CompositeRank(rows, [("spend", "desc"), ("customers", "DESC")], "MEAN").table
        assert values(table, "product_id", "spend_rank", "customers_rank", "composite_rank") == [(1, 3, 4, 3.5), (2, 2, 1, 1.5), (3, 3, 5, 4.0), (4, 1, 2, 1.5), (5, 5, 3, 4.0)]
        assert sorted(r["spend_rank"] for r in ops.CompositeRank(rows, ["spend"], "sum", ignore_ties=True).table.collect()) == [1, 2, 3, 4, 5]
        for wrong, error in (({"agg_func": "median"}, ValueError), ({"rank_cols": [("spend", "up")]}, ValueError), ({"rank_cols": ["none"]}, ValueError), ({"group_col": []}, ValueError), ({"group_col": 5}, TypeError)):
            with pytest.raises(error):
                ops.CompositeRank(rows, **{"rank_cols": ["spend"], "agg_func": "sum"} | wrong)

    def test_decision_hierarchy(self, spark):
        rows = [(1, 1, "A"), (1, 1, "B"), (1, 2, "C"), (2, 3, "A"), (2, 3, "D"), (3, 4, "E")]
        table = frame(spark, "customer_id long, transaction_id long, product_name string", rows)
        assert values(ops.CustomerDecisionHierarchy(table, "product_name").pairs, "customer_id", "product_name") == [(1, "C"), (3, "E")]
        every = ops.CustomerDecisionHierarchy(table, "product_name", exclude_same_transaction_products=False)
        assert every.pairs.count() == 6 and every.complete().count() == 10
        got = {(r["product_1"], r["product_2"]): (r["yules_q"], r["distance"]) for r in every.complete().collect()}
        assert got["B", "C"] == (1.0, 0.5) and got["A", "E"] == (-1.0, 1.5)
        met = {(r["product_1"], r["product_2"]): (r["yules_q"], r["distance"]) for r in every.table.collect()}
        assert met == {k: v for k, v in got.items() if k in met} and {v for k, v in got.items() if k not in met} == {(-1.0, 1.5)}
        matrix = every.matrix()
        assert all(matrix.loc[a, b] == matrix.loc[b, a] == d for (a, b), (_, d) in got.items()) and matrix.loc["A", "A"] == 0.5
        with pytest.raises(ValueError):
            every.matrix(most=4)
        steps = every.linkage()
        assert len(steps) == 4 and steps[-1][3] == 5 and [s[2] for s in steps] == sorted(s[2] for s in steps)

    def test_linkage_is_ward(self, spark):
        """Every merge is the one that adds least to the squared distances from the clusters' means."""
        import numpy as np

        class Given(ops.CustomerDecisionHierarchy):
            def __init__(self, points):
                self.points = points

            def matrix(self, most=2000):
                return pd.DataFrame(self.points)

        points = np.random.default_rng(3).normal(size=(25, 25))
        clusters = {i: [i] for i in range(25)}
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((points[a].mean(0) - points[b].mean(0)) ** 2).sum() * 2
        for step, (a, b, height, size) in enumerate(Given(points).linkage()):
            least = min(cost(clusters[i], clusters[j]) for i in clusters for j in clusters if i < j)
            assert height == pytest.approx(np.sqrt(least)) == pytest.approx(np.sqrt(cost(clusters[a], clusters[b])))
            clusters[25 + step] = clusters.pop(a) + clusters.pop(b)
            assert size == len(clusters[25 + step])
        assert Given(points[:1]).linkage() == [] and Given(points[:0]).linkage() == []

    def test_metrics(self, spark):
        rows = frame(spark, "store_id long, product_id long, region string, unit_spend double", [(1, 1, "N", 1e6), (2, 1, "N", 2e6), (3, 2, "S", None), (4, 1, "S", 5e5)])
        assert ops.Acv(rows).table.head()["acv"] == 3.5
        assert values(ops.Acv(rows, group_col="region", acv_scale_factor=1e5).table, "region", "acv") == [("N", 30.0), ("S", 5.0)]
        assert values(ops.PctOfStores(rows).table, "product_id", "stores", "stores_pct") == [(1, 3, 75.0), (2, 1, 25.0)]
        assert values(ops.PctOfStores(rows, group_col="region", within_group=True).table, "product_id", "region", "stores_pct") == [(1, "N", 100.0), (1, "S", 50.0), (2, "S", 50.0)]
        assert ops.PctOfStores(rows.limit(0)).table.count() == 0
        for wrong in (lambda: ops.Acv(rows, acv_scale_factor=0), lambda: ops.PctOfStores(rows, product_col="region", group_col="region")):
            with pytest.raises(ValueError):
                wrong()
        assert rows.agg(ratio_metric(F.sum("store_id"), F.lit(0)).alias("r")).head()["r"] is None

    def test_pandas_input(self, spark):
        got = ops.Acv(pd.DataFrame({"unit_spend": [1e6, float("nan"), 5e5]})).df
        assert got["acv"].tolist() == [1.5]
        with pytest.raises(TypeError):
            ops.Acv([1, 2])


class TestLabelsAndIndexes:
    def test_labels(self, spark):
        rows = frame(spark, "transaction_id long, on_promotion boolean", [(1, True), (1, True), (2, True), (2, False), (3, False), (3, None), (4, True)])
        assert values(ops.label_by_condition(rows, F.col("on_promotion"), labeling_strategy="extended"), "transaction_id", "label_name") == [(1, "contains"), (2, "mixed"), (3, "not_contains"), (4, "contains")]
        assert values(ops.label_by_condition(rows, F.col("on_promotion")), "label_name") == [("contains",)] * 3 + [("not_contains",)]
        picked = ops.filter_and_label_by_condition(rows, {"promo": F.col("on_promotion"), "first": F.col("transaction_id") == 1})
        assert values(picked, "label") == [("promo",)] * 4

    def test_periods(self, spark):
        rows = frame(spark, "transaction_date string", [("2023-01-01",), ("2023-01-31",), ("2023-02-01",), ("2024-05-01",)]).withColumn("transaction_date", F.to_date("transaction_date"))
        got = ops.filter_and_label_by_periods(rows, {"jan": ("2023-01-01", "2023-01-31"), "may": (datetime.date(2024, 5, 1), datetime.datetime(2024, 5, 2))})
        assert values(got, "period_name") == [("jan",), ("jan",), ("may",)]
        for wrong in ({"a": ("2023-01-01",)}, {"a": ("2023-02-01", "2023-01-01")}, {"a": ("2023-01-01", "2023-01-31"), "b": ("2023-01-31", "2023-02-05")}):
            with pytest.raises(ValueError):
                ops.filter_and_label_by_periods(rows, wrong)
        assert ops.find_overlapping_periods("2022-06-15", "2024-03-10") == [("2022-06-15", "2023-03-10"), ("2023-06-15", "2024-03-10")]
        assert ops.find_overlapping_periods("2022-01-01", "2022-12-31") == []
        assert ops.find_overlapping_periods(datetime.datetime(2022, 6, 15), datetime.datetime(2023, 3, 10), return_str=False)[0][0].tzinfo is None
        with pytest.raises(ValueError):
            ops.find_overlapping_periods("2024-01-01", "2023-01-01")
        with pytest.raises(TypeError):
            ops.find_overlapping_periods(datetime.datetime(2022, 1, 1), datetime.datetime(2023, 1, 1, tzinfo=datetime.UTC))

    def test_indexes(self, spark):
        rows = [("A", "B", "A", "B", "A", "C")[i % 6] for i in range(12)]
        table = frame(spark, "g string, s string, f string, v long", [(g, "DE"[i % 2], "XY"[i // 6], i + 1) for i, g in enumerate(rows)])
        plain = table.toPandas()
        whole, part = plain.groupby("g").v.sum(), plain[plain.f == "X"].groupby("g").v.sum()
        wanted = (part / part.sum()) / (whole / whole.sum()) * 100
        assert {r["g"]: pytest.approx(r["index"]) for r in ops.get_indexes(table, "X", "f", "v", "g").collect()} == wanted.to_dict()
        zero = frame(spark, "g string, s string, f string, v long", [("A", "D", "X", 0), ("A", "E", "X", 3), ("A", "D", "Y", 4)])
        assert values(ops.get_indexes(zero, "X", "f", "v", "g", "s"), "s", "g") == [("E", "A")]
        found = ops.get_indexes(table, "X", "f", "v", "g")
        assert ops.top_bottom(found, 1, 1).count() == 2 and ops.filter_by_groups(found, "g", include_only_groups=["A"]).count() == 1
        for wrong in (lambda: ops.top_bottom(found, 3, 3), lambda: ops.filter_by_value_thresholds(found, 1e9), lambda: ops.get_indexes(table, "X", "f", "v", "g", agg_func="std")):
            with pytest.raises(ValueError):
                wrong()

    def test_haversine(self, spark):
        rows = frame(spark, "a double, b double, c double, d double", [(37.7749, -122.4194, 40.7128, -74.0060), (34.0522, -118.2437, 36.1699, -115.1398), (0.0, 0.0, 0.0, 180.0)])
        got = [r[0] for r in rows.select(haversine_distance("a", "b", "c", "d")).collect()]
        assert got == [pytest.approx(4129.086165, rel=1e-3), pytest.approx(367.606322, rel=1e-3), pytest.approx(20015.0868, rel=1e-6)]

    def test_numbers_as_text(self):
        assert [human_number(x) for x in (0, 999, 1000, 1_500_000, -2_000, 999_999)] == ["0", "999", "1K", "2M", "-2K", "1M"]


def test_no_job_when_built(spark):
    """Operators only look at schemas when they are built."""
    tracker = spark.sparkContext.statusTracker()
    table = frame(spark, SALES_COLUMNS, SALES).withColumn("transaction_date", F.current_date()).withColumn("year", F.lit(1))
    spark.sparkContext.setJobGroup("build", "build")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        ops.SegTransactionStats(table)
        ops.HMLSegmentation(table)
        ops.RFMSegmentation(table)
        ops.NLRSegmentation(table, "year", 1, 2)
        ops.CohortAnalysis(table, "customer_id")
        ops.ProductAssociation(table, "segment_name")
        ops.RevenueTree(table, "year", 1, 2)
        ops.TransactionChurn(table, 5)
        ops.CustomerDecisionHierarchy(table, "segment_name")
    assert not tracker.getJobIdsForGroup("build")
    spark.sparkContext.setJobGroup("other", "other")
