"""Drawing on axes that record what is asked of them; matplotlib itself is not needed."""

import datetime
import math
import warnings
from types import SimpleNamespace as Fake

import pandas as pd
import pytest
from tallymark import charts
from tallymark import operators as ops
from tallymark.charts import plots, style
from tallymark.functions import distinct_decimals, human_number, truncate_to_x_digits
from tallymark.options import option_context
from tallymark.plugin import ExtensibleResult


class Patch:
    def __init__(self, x=0.0, y=0.0, width=1.0, height=1.0):
        self.box, self.hatch = (x, y, width, height), None

    get_x, get_y, get_width, get_height = (lambda self, i=i: self.box[i] for i in range(4))

    def set_hatch(self, hatch):
        self.hatch = hatch


class Axes:
    """Records calls as (name, args, kwargs); what tests look up can be set."""

    def __init__(self, lines=(), patches=(), collections=(), xlim=(0.0, 10.0), ylim=(0.0, 10.0)):
        self.calls, self.patches, self.collections = [], list(patches), list(collections)
        self._lines, self._xlim, self._ylim = list(lines), xlim, ylim
        side = Fake(set_visible=lambda shown: None)
        self.spines = {s: side for s in ("top", "right", "bottom", "left")}
        self.figure = Fake(text=lambda *a, **k: None, colorbar=lambda *a, **k: Fake(set_label=lambda t: self.calls.append(("colorbar", (t,), {}))))
        self.xaxis, self.yaxis = (Fake(axes=self, set_major_formatter=lambda f, n=n: self.calls.append((n, (f,), {}))) for n in ("x_format", "y_format"))
        self.xaxis_date = lambda: None

    def get_lines(self):
        return self._lines

    def get_xlim(self):
        return self._xlim

    def get_ylim(self):
        return self._ylim

    def get_legend(self):
        return None

    def __getattr__(self, name):
        def record(*args, **kwargs):
            self.calls.append((name, args, kwargs))
            return name

        return record

    def of(self, name):
        return [(a, k) for n, a, k in self.calls if n == name]


@pytest.fixture
def sums(spark):
    return spark.createDataFrame([("a", 3.0, 1.0), ("b", 1.0, 1.0), ("c", 2000.0, 0.0)], "g string, v double, w double")


def test_bars(sums):
    ax = Axes()
    assert plots.bar_plot(sums, ["v", "w"], "g", "T", ax=ax, sort_order="descending", data_label_format="percentage_by_series", source_text="us") is ax
    (first, second) = ax.of("bar")
    assert first[0][1] == [2000.0, 3.0, 1.0] and second[0][1] == [0.0, 1.0, 1.0] and second[1]["label"] == "w"
    assert ax.of("bar_label")[1][1]["labels"] == ["0%", "50%", "50%"] and ax.of("set_xticks")[0][0][1] == ["c", "a", "b"]
    assert ax.of("annotate")[0][0][0] == "Source: us" and ax.of("legend")
    lying = plots.bar_plot(sums, "v", "g", ax=Axes(), orientation="h", data_label_format="absolute", num_digits=1)
    assert lying.of("barh")[0][0][1] == [3.0, 1.0, 2000.0] and lying.of("bar_label")[0][1]["labels"] == ["3", "1", "2K"] and not lying.of("legend")
    stacked = plots.bar_plot(sums, ["v", "w"], "g", ax=Axes(), stacked=True)
    assert stacked.of("bar")[1][1]["bottom"] == [3.0, 1.0, 2000.0]
    zero = pd.DataFrame({"x": ["a", "b"], "p": [0.0, 2.0], "q": [0.0, 2.0]})
    with pytest.warns(UserWarning, match="0"):
        assert plots.bar_labels(zero, ["p", "q"], "percentage_by_bar_group") == {"p": ["", "50%"], "q": ["", "50%"]}
    for wrong in ({"orientation": "up"}, {"sort_order": "x"}, {"data_label_format": "x"}):
        with pytest.raises(ValueError):
            plots.bar_plot(sums, "v", "g", ax=Axes(), **wrong)


def test_lines_areas_points(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (1, "b", 5.0), (3, "b", None)], "x int, g string, v double")
    lines = plots.line_plot(rows, "v", "x", "g", highlight=["b"], fill_na_value=0, ax=Axes()).of("plot")
    assert [(a[1], k.get("label")) for a, k in lines] == [([1.0, 2.0, 0.0], None), ([5.0, 0.0, 0.0], "b")]
    areas = plots.area_plot(rows, "v", "x", "g", ax=Axes()).of("stackplot")
    assert areas[0][0] == ([1, 2, 3], [1.0, 2.0, 0.0], [5.0, 0.0, 0.0])
    ax = plots.scatter_plot(rows, "v", "x", "g", size_col="v", size_scale=10, label_col="g", ax=Axes())
    assert [(a[0], a[1], k["s"]) for a, k in ax.of("scatter")] == [([1, 2], [1.0, 2.0], [10.0, 20.0]), ([1], [5.0], [50.0])]
    assert len(ax.of("annotate")) == 3
    with pytest.raises(ValueError, match="more than 1 groups"):
        charts.line_series(rows, "x", "v", "g", most=1)
    histogram = plots.histogram_plot(rows, "v", 2, 0, 4, ax=Axes()).of("bar")
    assert histogram[0][0][:2] == ([0.0, 2.0], [1, 2])


def test_other_charts(spark):
    day = datetime.date
    table = spark.createDataFrame([(day(2024, 1, d), c, v) for d, c, v in ((1, "A", 5.0), (2, "A", 1.0), (2, "B", 2.0), (4, "A", 3.0))], "transaction_date date, category string, v double")
    assert [a[1] for a, _ in plots.time_plot(table, "v", "D", group_col="category", ax=Axes(), fill_na_value=0).of("plot")] == [[5.0, 1.0, 3.0], [0.0, 2.0, 0.0]]
    spans = plots.broken_timeline_plot(table, "category", "v", ax=Axes()).of("broken_barh")
    assert [[n for _, n in a[0]] for a, _ in spans] == [[2, 1], [1]]
    two = plots.period_on_period_plot(table, "v", [("2024-01-01", "2024-01-02"), ("2024-01-04", "2024-01-05")], ax=Axes()).of("plot")
    assert [k["label"] for _, k in two] == ["2024-01-01 to 2024-01-02", "2024-01-04 to 2024-01-05"]
    steps = spark.createDataFrame([(1, 100.0), (2, -30.0), (3, 0.0)], "i int, a double")
    ax = plots.waterfall_plot(steps, "i", "a", display_net_bar=True, data_label_format="both", ax=Axes())
    assert ax.of("bar")[0][0] == (["1", "2", "Net"], [100.0, -30.0, 70.0]) and ax.of("bar")[0][1]["bottom"] == [0.0, 100.0, 0.0]
    assert ax.of("bar_label")[0][1]["labels"][1] == "-30 (-43%)"
    prices = plots.price_plot(table, "v", "category", [0, 2, 6], ax=Axes())
    assert [a[1] for a, _ in prices.of("scatter")] == [[1.0, 4.0], [1.0]] or len(prices.of("annotate")) == 3
    shares = spark.createDataFrame([(g, "XY"[i % 2], float(i + 1)) for i, g in enumerate("ABCABCABCA")], "g string, f string, v double")
    bars = plots.index_plot(shares, "v", "g", "f", "X", sort_by="value", ax=Axes())
    assert bars.of("barh")[0][0][1] == sorted(bars.of("barh")[0][0][1]) and bars.of("axvspan")[0][0] == (80, 120)


def test_heat_maps_and_circles(spark):
    frame = pd.DataFrame([[1.0, 0.5], [1.0, float("nan")]], index=[datetime.date(2024, 1, 1), datetime.date(2024, 2, 1)], columns=[0, 1])
    ax = plots.cohort_plot(frame, "share", ax=Axes())
    assert [a[2] for a, _ in ax.of("text")] == ["100%", "50%", "100%"] and ax.of("set_yticks")[0][0][1] == ["2024-01-01", "2024-02-01"]
    assert [a[2] for a, _ in plots.heatmap_plot(frame, "x", ax=Axes()).of("text")] == ["1.00", "0.50", "1.00"]
    rows = spark.createDataFrame([(1, "A", 6.0), (2, "B", 2.0), (3, "A", 1.0), (3, "B", 1.0), (4, "C", 5.0)], "customer_id int, category string, unit_spend double")
    ax = ops.CrossShop(rows, "category", "A", "B").plot(vary_size=True, ax=Axes())
    assert len(ax.of("fill")) == 2 and [a[2] for a, _ in ax.of("text")][2:] == ["13%", "40%", "13%"]
    widths = [max(a[0]) - min(a[0]) for a, _ in ax.of("fill")]
    assert widths[0] ** 2 / widths[1] ** 2 == pytest.approx(8 / 4, rel=1e-6)
    with pytest.raises(ValueError):
        plots.venn_plot(ops.CrossShop(rows, "category", "A", "B").summary, ["a", "b", "c"], ax=Axes())


def test_trees(spark):
    order, shapes = plots.dendrogram_shapes([(0, 2, 1.0, 2), (1, 3, 2.0, 3)], 3)
    assert order == [1, 0, 2] and shapes == [([1.0, 1.0, 2.0, 2.0], [0.0, 1.0, 1.0, 0.0]), ([0.0, 0.0, 1.5, 1.5], [0.0, 2.0, 2.0, 1.0])]
    rows = spark.createDataFrame([(c, 10 * c + i, p) for c, ps in enumerate(("ab", "ab", "bc", "cd", "a")) for i, p in enumerate(ps)], "customer_id int, transaction_id int, product_name string")
    ax = ops.CustomerDecisionHierarchy(rows, "product_name").plot(ax=Axes(), orientation="right")
    assert len(ax.of("plot")) == 3 and sorted(ax.of("set_yticks")[0][0][1]) == list("abcd")
    sales = spark.createDataFrame([(c, 10 * p + c, s, u, f"P{p}") for c, p, s, u in ((1, 1, 100.0, 10), (2, 1, 50.0, 5), (1, 2, 300.0, 20), (3, 2, 20.0, 1))], "customer_id int, transaction_id int, unit_spend double, unit_quantity int, period string")
    tree = ops.RevenueTree(sales, "period", "P1", "P2")
    ax = tree.draw_tree(value_labels=("Now", "Before"), ax=Axes())
    told = [a[2] for a, _ in ax.of("text")]
    assert len(told) == 7 and any(t.startswith("Spend\nNow: 320\nBefore: 150") for t in told) and len(ax.of("plot")) == 6
    # the same measures from a small pandas frame, by masks
    totals = pd.DataFrame({"spend": [150.0, 320.0], "customers": [2, 2], "transactions": [2, 2], "units": [15, 21]}, index=["p1", "p2"])
    got = ops.calc_tree_kpis(totals, [True, False], [False, True])
    wanted = tree.df
    assert list(got.columns) == list(wanted.columns) and all(got.iloc[0][c] == pytest.approx(wanted.iloc[0][c], nan_ok=True) for c in got.columns)
    grouped = pd.DataFrame({"spend": [1.0, 2.0, 5.0], "customers": [1, 1, 1], "transactions": [1, 1, 1]}, index=["x", "y", "x"])
    got = ops.calc_tree_kpis(grouped, [True, True, False], [False, False, True])
    assert got.loc["x", "spend_diff"] == 4.0 and got.loc["y", "spend_p2"] == 0.0


def test_gain_loss_masks(spark):
    frame = pd.DataFrame({"customer_id": [1, 1, 2, 3], "unit_spend": [5.0, 3.0, 4.0, 2.0], "p": [1, 2, 1, 2], "b": ["f", "c", "f", "f"]})
    masks = [(frame["p"] == 1).tolist(), frame["p"] == 2, frame["b"] == "f", (frame["b"] == "c").tolist()]
    one = ops.GainLoss(frame, masks[0], masks[1], masks[2], "F", masks[3], "C")
    two = ops.GainLoss(frame, "p = 1", "p = 2", "b = 'f'", "F", "b = 'c'", "C")
    assert one.df.equals(two.df[one.df.columns])
    ax = one.plot(ax=Axes())
    assert [k["label"] for _, k in ax.of("barh")][:3] == ["New", "Increased F", "Switch From C"]
    for wrong, error in ((lambda: ops.GainLoss(frame, [True], masks[1], masks[2], "F", masks[3], "C"), ValueError), (lambda: ops.GainLoss(spark.createDataFrame(frame), masks[0], masks[1], masks[2], "F", masks[3], "C"), TypeError), (lambda: ops.GainLoss(frame, masks[0], masks[0], masks[2], "F", masks[3], "C"), ValueError)):
        with pytest.raises(error):
            wrong()


def test_regression_lines(spark):
    xs = [float(x) for x in range(1, 9)]
    for kind, f in (("linear", lambda x: 2 * x + 1), ("power", lambda x: 3 * x**2), ("logarithmic", lambda x: 2 * math.log(x) + 1), ("exponential", lambda x: 2 * math.exp(0.3 * x))):
        ys = [f(x) + 0.01 * (-1) ** i for i, x in enumerate(xs)]
        fit = plots.fitted(xs, ys, kind)
        table = charts.regression(spark.createDataFrame(list(zip(xs, ys, strict=True)), "x double, y double"), "x", "y", kind).head()
        assert all(fit[n] == pytest.approx(table[n]) for n in ("slope", "intercept", "r_squared"))
        line = Fake(get_visible=lambda: True, get_xdata=lambda: xs, get_ydata=lambda ys=ys: ys)
        ax = plots.add_regression_line(Axes([line]), kind)
        assert ax.of("plot")[0][1]["color"] == "red" and ", R2 = 1.00" in ax.of("text")[0][0][2]
    bars = Axes(patches=[Patch(k - 0.4, 0, 0.8, 2.0 * k + 1) for k in range(5)])
    assert plots.plotted_points(bars)[1] == [1.0, 3.0, 5.0, 7.0, 9.0] and plots.fitted(*plots.plotted_points(bars), "linear")["slope"] == pytest.approx(2)
    points = Axes(collections=[Fake(get_offsets=lambda: [(1.0, 2.0), (2.0, 4.0), (float("nan"), 1.0)])])
    assert plots.plotted_points(points) == ([1.0, 2.0], [2.0, 4.0])
    for wrong in (lambda: plots.add_regression_line(Axes()), lambda: plots.add_regression_line(bars, "cubic"), lambda: plots.fitted([0.0, 1.0], [1.0, 2.0], "power"), lambda: plots.fitted([1.0, 1.0], [1.0, 2.0], "linear")):
        with pytest.raises(ValueError):
            wrong()


def test_number_texts_and_styles():
    assert [human_number(1500, 1, "$"), human_number(1500, 2, trim=True), human_number(2000, 2, trim=True)] == ["$1.5K", "1.5K", "2K"]
    cases = {("999.999K", 4): "999.9K", ("-1.2399M", 3): "-1.23M", ("0.00", 3): "0", ("0K", 2): "0K", ("12345", 3): "12345", ("0.000012", 5): "0.00001", ("5.10", 2): "5.1", ("1000", 2): "1000"}
    assert {k: truncate_to_x_digits(*k) for k in cases} == cases
    assert distinct_decimals([1000, 1200, 1400], 0, 2000) == 1 and distinct_decimals([1, 2], 0, 5) == 0
    ax = Axes()
    ax.get_yticks = lambda: [1000, 1200, 1400]
    ax._ylim = (0, 2000)
    style.set_axis_format(ax.yaxis, "shorthand", prefix="$")
    style.set_axis_format(ax.xaxis, "percent", decimals=1, symbol=None)
    assert ax.of("y_format")[0][0][0](1200) == "$1.2K" and ax.of("x_format")[0][0][0](0.123) == "12.3"
    with pytest.raises(ValueError):
        style.set_axis_format(ax.xaxis, "roman")
    patches = [Patch() for _ in range(5)]
    style.apply_hatches(Axes(patches=patches), 2)
    assert [p.hatch for p in patches] == ["/"] * 3 + ["\\"] * 2
    assert style.fonts()["title"] == {"family": "Poppins", "weight": "semibold", "style": "normal", "size": 20.0} and style.fonts()["source"]["style"] == "italic"
    with option_context("plot.font.title_size", 9.0):
        assert style.fonts()["title"]["size"] == 9.0


def test_results_take_operators():
    five, frame = ExtensibleResult(5, "f"), ExtensibleResult(pd.Series([1, 2]), "f")
    assert (five + 1, 1 - five, five * five, five // 2, 2**five, -five, abs(five), five % 3) == (6, -4, 25, 2, 32, -5, 5, 2)
    assert five < 6 and five >= 5 and five != 4 and five == 5 and bool(five) and hash(five) == hash(5)
    assert (frame * 2).tolist() == [2, 4] and (frame > 1).tolist() == [False, True] and 1 in frame
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert (frame & frame).tolist() == [1, 2]
