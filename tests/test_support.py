"""Options, plugins, chart data, sources, streaming, and the registered queries."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F
from tallymark import catalog, charts, options, streaming
from tallymark.charts import style
from tallymark.charts.render import draw, tree_grid
from tallymark.plugin import Plugins, plugins
from tallymark.plans.skew import hot_keys, spread_join
from tallymark.sources import as_table, read_files, transactions, validate_columns, write_files

import __spark_entry__ as entry


def test_options(tmp_path):
    assert len(options.list_options()) == 69
    assert options.column("agg.unit_spend", "period_1") == "spend_p1"
    with options.option_context("column.customer_id", "cust", "plot.color.primary", "red"):
        assert options.get_option("column.customer_id") == "cust"
    assert options.get_option("column.customer_id") == "customer_id"
    assert "customer ids" in options.describe_option("column.customer_id")
    options.set_option("column.store_id", "shop")
    options.reset_option("column.store_id")
    assert options.get_option("column.store_id") == "store_id"
    for wrong in (lambda: options.get_option("x"), lambda: options.set_option("x", 1), lambda: options.option_context("a").__enter__()):
        with pytest.raises(ValueError):
            wrong()
    good, bad = tmp_path / options.CONFIG_NAME, tmp_path / "bad.toml"
    good.write_text('[column]\ncustomer_id = "c"\n[column.agg]\nstore_id = "s"\n[plot.font]\ntitle_size = 9.0\n')
    bad.write_text("[column]\nnone = 1\n")
    loaded = options.Options.load_from_toml(good)
    assert (loaded.get_option("column.customer_id"), loaded.get_option("column.agg.store_id"), loaded.get_option("plot.font.title_size")) == ("c", "s", 9.0)
    with pytest.raises(ValueError):
        options.Options.load_from_toml(bad)
    (tmp_path / "deep" / "er").mkdir(parents=True)
    assert options.project_file(tmp_path / "deep" / "er") == good


def test_plugins(spark):
    from tallymark.operators import RevenueTree

    assert isinstance(plugins, Plugins)
    plugins.register_method(RevenueTree, "rows", lambda self: self.table.count())
    table = spark.createDataFrame([(1, 1, 5.0, "a")], "customer_id long, transaction_id long, unit_spend double, p string")
    assert RevenueTree(table, "p", "a", "b").rows() == 1
    with pytest.raises(AttributeError):
        RevenueTree(table, "p", "a", "b").nothing
    own = Plugins()

    def double(x):
        return [x, x]

    plugins.register_function_extension(double, "total", sum)
    result = plugins.extensible(double)(4)
    assert result.total() == 8 and len(result) == 2 and result[0] == 4 and list(result) == [4, 4] and result == [4, 4]
    assert own.methods("none") == {}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_charts(spark):
    day = datetime.date
    table = spark.createDataFrame([(day(2024, 1, d), c, v) for d, c, v in ((1, "A", 5), (2, "A", 1), (2, "B", 2), (4, "A", 3), (9, "B", 1))], "transaction_date date, category string, v long")
    assert rows(charts.broken_timeline(table, "category", "v")) == [("A", day(2024, 1, 1), 2), ("A", day(2024, 1, 4), 1), ("B", day(2024, 1, 2), 1), ("B", day(2024, 1, 9), 1)]
    assert rows(charts.broken_timeline(table, "category", "v", "W")) == [("A", day(2024, 1, 1), 1), ("B", day(2024, 1, 1), 2)]
    assert rows(charts.time_series(table, "v", "W")) == [(day(2024, 1, 1), 11), (day(2024, 1, 8), 1)]
    numbers = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", 2.5), ("b", None)], "g string, x double")
    assert rows(charts.price_bands(numbers, "x", "g", [1, 2, 5])) == [("a", 0, 1.0, 2.0, 2 / 3), ("b", 1, 2.0, 5.0, 1.0)]
    assert {r["bin"] for r in charts.price_bands(numbers, "x", "g", 4).collect()} == {0, 3}
    assert [(r["bin"], r["n"]) for r in charts.histogram_bins(numbers, "x", 2, 2, 4).orderBy("bin").collect()] == [(0, 3), (1, 1)]
    assert [(r["bin"], r["n"]) for r in charts.histogram_bins(numbers, "x", 2, 2, 4, "fillna").collect()] == [(0, 2)]
    steps = spark.createDataFrame([(1, 100.0), (2, -30.0), (3, 0.0), (4, 10.0)], "i int, a double")
    assert rows(charts.waterfall_steps(steps, "i", "a").select("position", "base")) == [(1, 0.0), (2, 100.0), (4, 70.0)]
    assert rows(charts.bar_shares(steps, "i", ["a"], "series").select("x", "share"))[0] == (1, 125.0)
    assert charts.line_series(numbers, "x", "x", "g", ["a"]).columns == ["x", "b", "a"]
    assert charts.scatter_points(numbers, "x", "x", "x", 2.0, "g").count() == 4
    line = spark.createDataFrame([(float(x), 3.0 * x**2) for x in range(1, 9)], "x double, y double")
    power = charts.regression(line, "x", "y", "power").head()
    assert (power["slope"], power["intercept"], power["r_squared"]) == (pytest.approx(2), pytest.approx(3), pytest.approx(1))
    for wrong in (lambda: charts.regression(line, "x", "y", "cubic"), lambda: charts.time_series(table, "v", "Z"), lambda: charts.price_bands(numbers, "x", "g", [3, 1]), lambda: charts.histogram_bins(numbers, "x", 0, 1, 2)):
        with pytest.raises(ValueError):
            wrong()


def test_index_bars(spark):
    table = spark.createDataFrame([(g, "XY"[i % 2], float(i + 1)) for i, g in enumerate("ABCABCABCA")], "g string, f string, v double")
    bars = charts.index_bars(table, "X", "f", "v", "g", sort_by="value", ascending=False, highlight=(90, 110))
    got = bars.collect()
    assert [r["index"] for r in got] == sorted((r["index"] for r in got), reverse=True)
    assert all((r["tone"] == "positive") == (r["index"] > 10) for r in got)
    assert charts.index_bars(table, "X", "f", "v", "g", top_n=1, bottom_n=1).count() == 2
    for wrong in ({"sort_by": "x"}, {"series_col": "f", "top_n": 1}, {"exclude_groups": ["A"], "include_only_groups": ["B"]}, {"filter_above": 1e9}):
        with pytest.raises(ValueError):
            charts.index_bars(table, "X", "f", "v", "g", **wrong)


def test_style():
    assert [style.percent_label(0.125, 1), style.percent_label(None)] == ["12.5%", ""]
    assert [style.value_label(1500, 3000, 1), style.value_label(5), style.value_label(None)] == ["1.5K (50.0%)", "5", ""]
    assert [style.shorten("abcdefgh", 6), style.shorten("abc", 6)] == ["abc...", "abc"]
    assert len(style.palette(2)) == 2 and len(style.palette(30)) == 30
    assert style.tone(0.5) == options.get_option("plot.color.positive") and style.tone(None) == options.get_option("plot.color.neutral")
    fit = {"slope": 2.0, "intercept": -1.0, "r_squared": 0.5}
    assert style.regression_text(fit) == "y = 2.00x - 1.00, R2 = 0.50"
    assert style.regression_curve(fit, "linear", 0, 1, 3) == [(0, -1.0), (0.5, 0.0), (1.0, 1.0)]
    assert style.regression_curve({"slope": 2.0, "intercept": 3.0}, "power", 1, 2, 2) == [(1.0, 3.0), (2.0, 12.0)]
    for wrong in (lambda: style.shorten("a", 3), lambda: style.regression_curve(fit, "cubic", 0, 1), lambda: style.regression_text(fit, "cubic"), lambda: style.regression_curve(fit, "linear", 1, 0)):
        with pytest.raises(ValueError):
            wrong()


def test_drawing_is_optional():
    nodes = {"s": {"children": ["a", "b"]}, "a": {"children": []}, "b": {"children": []}}
    assert tree_grid(nodes, "s") == [("s", 0, 0.5), ("a", 1, 0.0), ("b", 1, 1.0)]
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="matplotlib"):
            draw("line", None)


def test_sources(spark, small, tmp_path):
    table = transactions(spark, small)
    assert table.count() == 6000
    validate_columns(table, ["customer_id"])
    with pytest.raises(ValueError, match="nothing"):
        validate_columns(table, ["nothing"])
    with pytest.raises(TypeError):
        validate_columns(table, "customer_id")
    assert as_table(table) is table
    few = table.select("customer_id", "unit_spend", "brand").limit(20)
    for kind in ("parquet", "orc", "json", "csv"):
        write_files(few, str(tmp_path / kind), kind)
        assert read_files(spark, str(tmp_path / kind), kind, "customer_id long, unit_spend double, brand string").count() == 20


def test_streaming(spark, small, tmp_path):
    source = tmp_path / "in"
    spark.read.parquet(f"{small}/events.parquet").repartition(3).write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    events = streaming.read_events(spark, str(source), schema, 10)
    streaming.run_to(streaming.deduplicated(events, "event_id", "ts", "40 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(str(source)).select("event_id").distinct().count()
    batch = spark.read.parquet(str(source)).groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours"), "event_type").count()
    query = streaming.windowed(events, "ts", ["event_type"], "6 hours", late="40 days", value_col="value").writeStream.format("memory").outputMode("complete").queryName("w").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("w").count() == batch.count() and spark.table("w").agg(F.sum("n")).head()[0] == batch.agg(F.sum("count")).head()[0]
    query = streaming.sessions(events, "ts", "user_id", "2 hours", "40 days").writeStream.format("memory").outputMode("complete").queryName("s").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("s").agg(F.sum("n")).head()[0] == batch.agg(F.sum("count")).head()[0]


def plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 3) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    sql = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, small)
    names = sorted(got.columns)
    assert names == sorted(sql.columns)
    at = [sql.columns.index(c) for c in names]
    key = lambda r: tuple(map(str, r))
    ours = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=key)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=key)
    assert ours == theirs


def test_hierarchy_over_all_segments(spark, small):
    shopped = transactions(spark, small).select("customer_id", "segment_name", "brand").distinct()
    pairs = catalog.queries()["cdh_pairs"](spark, small)
    assert pairs.join(shopped, ["customer_id", "brand"]).select("segment_name").distinct().count() == shopped.select("segment_name").distinct().count() > 1
    held = {r["brand"]: r["n"] for r in shopped.groupBy("brand").agg(F.count_distinct("customer_id").alias("n")).collect()}
    for r in catalog.queries()["cdh_distances"](spark, small).collect():
        assert (r["n_1"], r["n_2"]) == (held[r["product_1"]], held[r["product_2"]])


def test_levels_of_all_customers(spark, small):
    customers = sorted(r[0] for r in transactions(spark, small).select("customer_id").distinct().collect())
    for name in ("hml_separate", "hml_include_light"):
        assert sorted(r["customer_id"] for r in catalog.queries()[name](spark, small).collect()) == customers
    assert 0 < catalog.queries()["hml_exclude"](spark, small).count() < len(customers)


def test_entry(spark, small):
    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_spread_join(spark):
    """A key with a third of the rows, null keys, keys without a partner, and a right side of several rows per key."""
    left = spark.range(9_000).selectExpr("case when id % 3 = 0 then 7 when id % 41 = 0 then null else id end as k", "id as a")
    right = spark.range(6_000).selectExpr("id as k", "id * 2 as b").unionByName(spark.createDataFrame([(7, -1), (None, -2)], "k long, b long"))
    hot = hot_keys(left.groupBy("k").agg(F.count("*").alias("n")), "k", 9_000)
    assert hot == [(7, 3001 // 5 + 1)]
    assert hot_keys(left.groupBy("k").agg(F.count("*").alias("n")), "k", 9_000, least=4_000) == []
    for how in ("inner", "left"):
        for keys in (hot, []):
            got = spread_join(left, right, "k", "a", keys, how)
            assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
    assert "__part" in spread_join(left, right, "k", "a", hot)._jdf.queryExecution().toString()
    names = left.selectExpr("unhex(hex(k)) as k", "a")
    hot = hot_keys(names.groupBy("k").agg(F.count("*").alias("n")), "k", 9_000)
    assert len(hot) == 1 and spread_join(names, names.select("k").distinct(), "k", "a", hot).count() == names.filter("k is not null").count()
