"""Registered queries of the retail operators over the star schema, and their SQL equivalents.

Doubles are rounded on both sides, since sums of doubles depend on their order; a small nudge
before that keeps values that lie just between two results from falling to either side.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import charts
from . import operators as ops
from .functions import haversine_distance, ratio_metric
from .plans.grouping import cube, rollup
from .plans.spread import dealt, parts
from .sources import as_table, read_files, table, transactions, write_files
from .storage import new_uri

NUDGE = 1e-7

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TX = """tx as (
  select l_orderkey transaction_id, l_partkey product_id, l_suppkey store_id, l_quantity unit_quantity, l_extendedprice unit_spend,
         l_discount discount, l_returnflag = 'R' on_promotion, o_custkey customer_id, cast(o_orderdate as date) transaction_date,
         cast(year(o_orderdate) as int) "year", c_mktsegment segment_name, c_nationkey nation, p_brand brand, p_type category, p_size size, p_retailprice unit_price
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey)"""


def query(name: str, sql: str | None = None, digits: int = 4) -> Callable[[Query], Query]:
    """Register a query; its doubles are rounded to ``digits`` as the SQL does."""

    def add(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = function(spark, sf_dir)
            doubles = {f.name for f in out.schema.fields if f.dataType.typeName() in ("double", "float")}
            return out.select([F.round(F.col(f"`{c}`") + F.lit(NUDGE), digits).alias(c) if c in doubles else F.col(f"`{c}`") for c in out.columns])

        _QUERIES[name] = run
        if sql:
            full = sql if not sql.startswith("+") else f"with {TX}{sql[1:]}"
            _SQL[name] = full.replace("round(", f"round({NUDGE} + ")
        return function

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- segment statistics

_BASE = "sum(unit_spend) s, count(distinct transaction_id) t, sum(unit_quantity) u, count(distinct customer_id) c"
_STATS = """round(s, 4) spend, t transactions, round(u, 4) units, c customers, round(s / nullif(c, 0), 4) spend_per_customer,
  round(t / nullif(c, 0), 4) transactions_per_customer, round(s / nullif(t, 0), 4) spend_per_transaction,
  round(s / nullif(u, 0), 4) price_per_unit, round(u / nullif(t, 0), 4) units_per_transaction"""


def _sets(keys: str, grouping: str) -> str:
    shown = ", ".join(f"case when grouping({k}) = 1 then 'Total' else {k} end {k}" for k in keys.split(", "))
    return f"+ , g as (select {shown}, {_BASE} from tx group by {grouping}) select {keys}, {_STATS} from g"


@query("seg_stats_total", _sets("segment_name", "grouping sets ((segment_name), ())"))
def seg_stats_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.SegTransactionStats(transactions(spark, sf_dir), "segment_name", grouping_sets="total").table


@query("seg_stats_rollup", _sets("segment_name, category", "rollup (segment_name, category)"))
def seg_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.SegTransactionStats(transactions(spark, sf_dir), ["segment_name", "category"], grouping_sets="rollup").table


@query("seg_stats_cube", _sets("segment_name, category", "cube (segment_name, category)"))
def seg_stats_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.SegTransactionStats(transactions(spark, sf_dir), ["segment_name", "category"], grouping_sets="cube").table


@query("seg_stats_grouping_sets", _sets("segment_name, category", "grouping sets ((segment_name, category), (category))"))
def seg_stats_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.SegTransactionStats(transactions(spark, sf_dir), ["segment_name", "category"], grouping_sets=[("segment_name", "category"), ("category",)]).table


@query("seg_stats_cube_fixed", _sets("segment_name, category, brand", "grouping sets ((segment_name, category, brand), (segment_name, brand), (category, brand), (brand))"))
def seg_stats_cube_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.SegTransactionStats(transactions(spark, sf_dir), ["segment_name", "category", "brand"], grouping_sets=[(cube("segment_name", "category"), "brand")]).table


@query("seg_stats_rollup_fixed", _sets("segment_name, category, brand", "grouping sets ((segment_name, category, brand), (segment_name, brand), (brand))"))
def seg_stats_rollup_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.SegTransactionStats(transactions(spark, sf_dir), ["segment_name", "category", "brand"], grouping_sets=[(rollup("segment_name", "category"), "brand")]).table


@query("seg_stats_legacy_rollup", _sets("segment_name, category", "grouping sets ((segment_name, category), (segment_name), (category), ())"))
def seg_stats_legacy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.SegTransactionStats(transactions(spark, sf_dir), ["segment_name", "category"], calc_total=True, calc_rollup=True).table


_U = "customer_id % 50 = 0"


@query(
    "seg_stats_unknown",
    f"""+ , g as (select case when grouping(segment_name) = 1 then 'Total' else segment_name end segment_name,
      coalesce(sum(unit_spend) filter (not {_U}), 0) s, coalesce(sum(unit_spend) filter ({_U}), 0) s_u, sum(unit_spend) s_t,
      count(distinct transaction_id) filter (not {_U}) t, count(distinct transaction_id) filter ({_U}) t_u, count(distinct transaction_id) t_t,
      coalesce(sum(unit_quantity) filter (not {_U}), 0) u, coalesce(sum(unit_quantity) filter ({_U}), 0) u_u, sum(unit_quantity) u_t,
      count(distinct customer_id) filter (not {_U}) c from tx group by grouping sets ((segment_name), ()))
    select segment_name, round(s, 4) spend, round(s_u, 4) spend_unknown, round(s_t, 4) spend_total, t transactions, t_u transactions_unknown, t_t transactions_total,
      round(u, 4) units, round(u_u, 4) units_unknown, round(u_t, 4) units_total, c customers,
      round(s / nullif(c, 0), 4) spend_per_customer, round(t / nullif(c, 0), 4) transactions_per_customer,
      round(s / nullif(t, 0), 4) spend_per_transaction, round(s / nullif(u, 0), 4) price_per_unit, round(u / nullif(t, 0), 4) units_per_transaction,
      round(s_u / nullif(t_u, 0), 4) spend_per_transaction_unknown, round(s_u / nullif(u_u, 0), 4) price_per_unit_unknown, round(u_u / nullif(t_u, 0), 4) units_per_transaction_unknown,
      round(s_t / nullif(t_t, 0), 4) spend_per_transaction_total, round(s_t / nullif(u_t, 0), 4) price_per_unit_total, round(u_t / nullif(t_t, 0), 4) units_per_transaction_total
    from g""",
)
def seg_stats_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.SegTransactionStats(transactions(spark, sf_dir), "segment_name", grouping_sets="total", unknown_customer_value=F.col("customer_id") % 50 == 0).table


@query(
    "seg_stats_extra_aggs",
    f"""+ , g as (select case when grouping(segment_name) = 1 then 'Total' else segment_name end segment_name, {_BASE},
      count(distinct store_id) stores, avg(unit_price) mean_price, max(size) largest, quantile_cont(unit_spend, 0.5) median_spend from tx group by rollup (segment_name))
    select segment_name, {_STATS}, stores, round(mean_price, 4) mean_price, largest, round(median_spend, 4) median_spend from g""",
)
def seg_stats_extra_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = {"stores": ("store_id", "nunique"), "mean_price": ("unit_price", "mean"), "largest": ("size", "max"), "median_spend": ("unit_spend", "median")}
    return ops.SegTransactionStats(transactions(spark, sf_dir), "segment_name", grouping_sets="total", extra_aggs=extra).table


# ---- customer segmentations


@query(
    "threshold_quartiles",
    """+ , v as (select customer_id, sum(unit_spend) unit_spend from tx group by customer_id),
    r as (select *, percent_rank() over (order by unit_spend, customer_id) p from v where unit_spend != 0)
    select customer_id, round(unit_spend, 2) unit_spend, case when p <= .25 then 'Q1' when p <= .5 then 'Q2' when p <= .75 then 'Q3' when p <= 1 then 'Q4' end segment_name from r
    union all select customer_id, round(unit_spend, 2), 'Zero' from v where unit_spend = 0""",
    2,
)
def threshold_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ThresholdSegmentation(transactions(spark, sf_dir), [0.25, 0.5, 0.75, 1.0], ["Q1", "Q2", "Q3", "Q4"]).table


@query(
    "threshold_grouped",
    """+ , v as (select customer_id, category, count(distinct product_id) product_id from tx group by all),
    r as (select *, percent_rank() over (partition by category order by product_id, customer_id) p from v)
    select customer_id, category, product_id, case when p <= .3 then 'Few' when p <= .9 then 'Some' end segment_name from r""",
)
def threshold_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ThresholdSegmentation(transactions(spark, sf_dir), [0.3, 0.9], ["Few", "Some"], value_col="product_id", agg_func="nunique", group_col="category").table


_HML = """+ , v as (select customer_id, sum(case when on_promotion and "year" = 1998 then unit_spend else 0 end) promo_spend from tx group by customer_id),
    r as (select *, percent_rank() over (order by promo_spend, customer_id) p from v {0})
    select customer_id, round(promo_spend, 2) promo_spend, case when p <= .5 then 'Light' when p <= .8 then 'Medium' else 'Heavy' end segment_name from r {1}"""


def _promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows; the value is the spend on promotion in one year, so customers without any are of value 0."""
    return transactions(spark, sf_dir).withColumn("promo_spend", F.when(F.col("on_promotion") & (F.col("year") == 1998), F.col("unit_spend")).otherwise(0.0))


@query("hml_separate", _HML.format("where promo_spend != 0", "union all select customer_id, round(promo_spend, 2), 'Zero' from v where promo_spend = 0"), 2)
def hml_separate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.HMLSegmentation(_promoted(spark, sf_dir), "promo_spend").table


@query("hml_exclude", _HML.format("where promo_spend != 0", ""), 2)
def hml_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.HMLSegmentation(_promoted(spark, sf_dir), "promo_spend", zero_value_customers="exclude").table


@query("hml_include_light", _HML.format("", ""), 2)
def hml_include_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.HMLSegmentation(_promoted(spark, sf_dir), "promo_spend", zero_value_customers="include_with_light").table


_RFM = """+ , v as (select customer_id, cast(date_diff('day', max(transaction_date), date '2001-08-02') as int) recency_days,
      cast(count(distinct transaction_id) as int) frequency, sum(unit_spend) monetary from tx group by customer_id), f as (select * from v {0}),
    s as (select *, {1} r_score, {2} f_score, {3} m_score from f)
    select customer_id, recency_days, frequency, round(monetary, 2) monetary, cast(r_score as int) r_score, cast(f_score as int) f_score, cast(m_score as int) m_score,
      cast(r_score * 100 + f_score * 10 + m_score as int) rfm_segment, cast(f_score * 10 + m_score as int) fm_segment from s"""


def _tile(order: str, n: int = 10) -> str:
    return f"ntile({n}) over (order by {order}, customer_id) - 1"


def _cuts(order: str, cuts: list[float]) -> str:
    rank = f"percent_rank() over (order by {order}, customer_id)"
    return " + ".join(f"(case when {rank} > {c} then 1 else 0 end)" for c in cuts)


@query("rfm_ntile", _RFM.format("", _tile("recency_days desc"), _tile("frequency"), _tile("monetary")), 2)
def rfm_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.RFMSegmentation(transactions(spark, sf_dir), "2001-08-02").table


@query("rfm_cutpoints", _RFM.format("", _cuts("recency_days desc", [0.2, 0.5, 0.8]), _tile("frequency", 4), _cuts("monetary", [0.5, 0.9])), 2)
def rfm_cutpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.RFMSegmentation(transactions(spark, sf_dir), datetime.date(2001, 8, 2), [0.2, 0.5, 0.8], 4, [0.5, 0.9]).table


@query("rfm_filtered", _RFM.format("where monetary >= 20000 and monetary <= 2000000 and frequency >= 5 and frequency <= 14", _tile("recency_days desc", 5), _tile("frequency", 5), _tile("monetary", 5)), 2)
def rfm_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.RFMSegmentation(transactions(spark, sf_dir), "2001-08-02", 5, 5, 5, min_monetary=20000, max_monetary=2000000, min_frequency=5, max_frequency=14).table


_NLR = """+ , v as (select {0}, {1} unit_spend_p1, {2} unit_spend_p2 from tx where "year" in (1998, 1999) group by {0})
    select {0}, case when unit_spend_p1 > 0 and unit_spend_p2 > 0 then 'Repeating' when unit_spend_p1 > 0 then 'Lapsed' else 'New' end segment_name,
      round(unit_spend_p1, 2) unit_spend_p1, round(unit_spend_p2, 2) unit_spend_p2 from v where unit_spend_p1 > 0 or unit_spend_p2 > 0"""


def _period(function: str, year: int) -> str:
    return f'coalesce({function}(unit_spend) filter ("year" = {year}), 0)'


@query("nlr", _NLR.format("customer_id", _period("sum", 1998), _period("sum", 1999)), 2)
def nlr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.NLRSegmentation(transactions(spark, sf_dir), "year", 1998, 1999).table


@query("nlr_grouped", _NLR.format("customer_id, category", _period("max", 1998), _period("max", 1999)), 2)
def nlr_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.NLRSegmentation(transactions(spark, sf_dir), "year", 1998, 1999, agg_func="max", group_col="category").table


def _products(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Units, customers and trips of products: a row per kind and value, so that distinct counts need no
    shuffle besides the one that brings a product's rows together."""
    lines = transactions(spark, sf_dir)
    number, by = parts(lines), ["product_id", *keys]
    rows = lines.select(*by, F.col("unit_quantity").cast("long").alias("units"), "customer_id", "transaction_id")
    rows = dealt(rows, number, "product_id") if number else rows
    value = lambda c, t, u: F.struct(c.alias("c"), t.alias("t"), u.alias("u"))
    none, customer, trip = F.lit(None).cast("long"), F.col("customer_id"), F.col("transaction_id")
    kinds = F.array(value(customer, none, F.col("units")), value(none, trip, none))
    seen = rows.select(*by, F.inline(kinds)).groupBy(*by, "c", "t").agg(F.sum("u").alias("u"))
    return seen.groupBy(*by).agg(F.sum("u").alias("units"), F.count("c").alias("customers"), F.count("t").alias("trips"))


_PRODUCTS = "p as (select product_id{0}, cast(sum(cast(unit_quantity as bigint)) as bigint) units, count(distinct customer_id) customers, count(distinct transaction_id) trips from tx group by all)"


@query(
    "composite_rank_mean",
    "+ , " + _PRODUCTS.format("") + """, r as (select *, rank() over (order by units desc) units_rank, rank() over (order by customers desc) customers_rank, rank() over (order by trips) trips_rank from p)
    select *, round((units_rank + customers_rank + trips_rank) / 3, 4) composite_rank from r""",
)
def composite_rank_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.CompositeRank(_products(spark, sf_dir), [("units", "desc"), ("customers", "DESC"), "trips"], "mean").table


@query(
    "composite_rank_grouped",
    "+ , " + _PRODUCTS.format(", brand") + """, r as (select *, rank() over (partition by brand order by units desc) units_rank, rank() over (partition by brand order by customers) customers_rank from p)
    select *, least(units_rank, customers_rank) composite_rank from r""",
)
def composite_rank_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.CompositeRank(_products(spark, sf_dir, "brand"), [("units", "desc"), "customers"], "min", group_col="brand").table


@query(
    "composite_rank_grouped_rownum",
    """+ , c as (select customer_id, segment_name, sum(cast(unit_spend * 100 as bigint)) cents from tx group by all)
    select customer_id, segment_name, cast(cents * 100000 + customer_id as bigint) k, row_number() over (partition by segment_name order by cents * 100000 + customer_id desc) k_rank,
      row_number() over (partition by segment_name order by cents * 100000 + customer_id desc) composite_rank from c""",
)
def composite_rank_grouped_rownum(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = transactions(spark, sf_dir).groupBy("customer_id", "segment_name").agg(F.sum(F.round(F.col("unit_spend") * 100).cast("long")).alias("cents"))
    return ops.CompositeRank(spend.select("customer_id", "segment_name", (F.col("cents") * 100000 + F.col("customer_id")).alias("k")), [("k", "desc")], "sum", ignore_ties=True, group_col="segment_name").table


# ---- labels and metrics

_RANGES = {"spring": ("1998-03-01", "1998-05-31"), "summer": ("1998-06-01", "1998-08-31"), "late": ("2000-01-01", "2000-02-15")}


@query(
    "filter_label_periods",
    """+ select period_name, count(*) n, round(sum(unit_spend), 2) spend from (select *, case when transaction_date between date '1998-03-01' and date '1998-05-31' then 'spring'
      when transaction_date between date '1998-06-01' and date '1998-08-31' then 'summer' when transaction_date between date '2000-01-01' and date '2000-02-15' then 'late' end period_name from tx)
      where period_name is not null group by period_name""",
    2,
)
def filter_label_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.filter_and_label_by_periods(transactions(spark, sf_dir), _RANGES).groupBy("period_name").agg(F.count("*").alias("n"), F.sum("unit_spend").alias("spend"))


@query(
    "filter_label_condition",
    """+ select label, count(*) n, count(distinct product_id) products from (select *, case when size < 10 then 'small' when unit_price > 1500 then 'dear' when size > 45 then 'large' end "label" from tx)
      where "label" is not null group by "label" """,
)
def filter_label_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = {"small": F.col("size") < 10, "dear": F.col("unit_price") > 1500, "large": F.col("size") > 45}
    return ops.filter_and_label_by_condition(transactions(spark, sf_dir), conditions).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("product_id").alias("products"))


@query("label_binary", "+ select transaction_id, case when bool_or(on_promotion) then 'contains' else 'not_contains' end label_name from tx group by transaction_id")
def label_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.label_by_condition(transactions(spark, sf_dir), F.col("on_promotion"))


@query("label_extended", "+ select customer_id, case when bool_and(discount > 0.05) then 'all' when bool_or(discount > 0.05) then 'some' else 'none' end kind from tx group by customer_id")
def label_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.label_by_condition(transactions(spark, sf_dir), F.col("discount") > 0.05, "customer_id", "kind", "extended", "all", "none", "some")


@query("acv_total", "+ select round(sum(unit_spend) / 1000000, 4) acv from tx")
def acv_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.Acv(transactions(spark, sf_dir)).table


@query("acv_by_store", "+ select store_id, segment_name, round(sum(unit_spend) / 1000, 4) acv from tx group by all")
def acv_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.Acv(transactions(spark, sf_dir), group_col=["store_id", "segment_name"], acv_scale_factor=1000).table


@query("pct_of_stores", "+ select product_id, count(distinct store_id) stores, round(count(distinct store_id) / (select count(distinct store_id) from tx) * 100, 4) stores_pct from tx group by product_id")
def pct_of_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.PctOfStores(transactions(spark, sf_dir)).table


@query(
    "pct_of_stores_grouped",
    "+ select brand, category, count(distinct store_id) stores, round(count(distinct store_id) / (select count(distinct store_id) from tx) * 100, 4) stores_pct from tx group by all",
)
def pct_of_stores_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.PctOfStores(transactions(spark, sf_dir), product_col="brand", group_col="category").table


@query(
    "pct_of_stores_within_group",
    """+ , g as (select segment_name, count(distinct store_id) n from tx group by all)
    select product_id, segment_name, count(distinct store_id) stores, round(count(distinct store_id) / any_value(n) * 100, 4) stores_pct from tx join g using (segment_name) group by all""",
)
def pct_of_stores_within_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.PctOfStores(transactions(spark, sf_dir), group_col="segment_name", within_group=True).table


@query("ratio_metric", "+ select brand, round(sum(discount * unit_spend) / nullif(sum(unit_spend), 0) * 100, 4) discount_pct from tx group by brand")
def ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).groupBy("brand").agg(ratio_metric(F.sum(F.col("discount") * F.col("unit_spend")), F.sum("unit_spend")).alias("discount_pct"))


_LAT, _LON = "(c_nationkey * 5.0 - 60)", "(c_nationkey * 13.0 - 150)"


@query(
    "haversine",
    f"""select c_custkey, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(51.5) - radians({_LAT})) / 2), 2)
      + cos(radians({_LAT})) * cos(radians(51.5)) * pow(sin((radians(-0.12) - radians({_LON})) / 2), 2)))), 4) km from customer""",
)
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", haversine_distance(nation * 5.0 - 60, nation * 13.0 - 150, F.lit(51.5), F.lit(-0.12)).alias("km"))


_INDEX = """+ , a as (select {0}, sum(unit_spend) w, sum(unit_spend) filter (segment_name = 'BUILDING') p from tx group by {0}),
    b as (select *, w / nullif(sum(w) over ({1}), 0) ws, p / nullif(sum(p) over ({1}), 0) ps from a) select {0}, round(ps / nullif(ws, 0) * 100 - {2}, 4) "index" from b where p is not null"""


@query("index_basic", _INDEX.format("category", "", "0"))
def index_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.get_indexes(transactions(spark, sf_dir), "BUILDING", "segment_name", "unit_spend", "category")


@query("index_subgroup", _INDEX.format("category, brand", "partition by category", "100"))
def index_subgroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.get_indexes(transactions(spark, sf_dir), "BUILDING", "segment_name", "unit_spend", "brand", "category", offset=100)


_INDEX_ROWS = _INDEX.format("brand", "", "0").replace("+ , a as", "+ , a as", 1)


@query("index_top_bottom", "+ , i as (select * from (" + _INDEX_ROWS.replace("+ , a as", "with a as") + """)) (select * from i order by "index" desc, brand limit 3) union all (select * from i order by "index", brand limit 2)""")
def index_top_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_bottom(ops.get_indexes(transactions(spark, sf_dir), "BUILDING", "segment_name", "unit_spend", "brand"), 3, 2)


@query("index_filtered", "+ , i as (select * from (" + _INDEX_ROWS.replace("+ , a as", "with a as") + """)) select * from i where "index" > 95 and "index" < 105 and brand not in ('Brand#11', 'Brand#12')""")
def index_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.get_indexes(transactions(spark, sf_dir), "BUILDING", "segment_name", "unit_spend", "brand")
    return ops.filter_by_value_thresholds(ops.filter_by_groups(found, "brand", exclude_groups=["Brand#11", "Brand#12"]), 95, 105, check=False)


# ---- joins


def _assoc(item: str, where: str, having: str, least: int = 1) -> str:
    return f"""+ , d as (select distinct transaction_id g, {item} i from tx), n as (select count(distinct g) n from d),
    o as (select i, count(*) c from d group by i having count(*) >= {least}),
    m as (select a.i x, b.i y, count(*) k from d a join d b on a.g = b.g and a.i != b.i group by all)
    select x {item}_1, y {item}_2, o1.c occurrences_1, o2.c occurrences_2, k cooccurrences, round(k / n, 6) support, round(k / o1.c, 6) confidence, round((k / n) / ((o1.c / n) * (o2.c / n)), 6) uplift
    from m join o o1 on x = o1.i join o o2 on y = o2.i, n where {where} and {having}"""


@query("assoc_all", _assoc("category", "true", "true"), 6)
def assoc_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ProductAssociation(transactions(spark, sf_dir), "category").table


@query("assoc_target", _assoc("brand", "x in ('Brand#11', 'Brand#23')", "k / o1.c >= 0.1 and (k / n) / ((o1.c / n) * (o2.c / n)) >= 0.5"), 6)
def assoc_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ProductAssociation(transactions(spark, sf_dir), "brand", target_item=["Brand#11", "Brand#23"], min_confidence=0.1, min_uplift=0.5).table


@query("assoc_sparse", _assoc("product_id", "true", "k >= 2", 5), 6)
def assoc_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ProductAssociation(transactions(spark, sf_dir), "product_id", min_occurrences=5, min_cooccurrences=2).table


def _cross(names: list[str]) -> str:
    flags = ", ".join(f"max(cast(category = '{n}' as int)) group_{i}" for i, n in enumerate(names, 1))
    label = "array_to_string(list_filter([" + ", ".join(f"case when group_{i} = 1 then '{chr(64 + i)}' end" for i in range(1, len(names) + 1)) + "], lambda x: x is not null), ', ')"
    cols = ", ".join(f"group_{i}" for i in range(1, len(names) + 1))
    return f"""+ , f as (select customer_id, {flags}, sum(unit_spend) v from tx group by customer_id),
    l as (select *, coalesce(nullif({label}, ''), 'No Groups') group_labels from f) select customer_id, {cols}, group_labels, round(v, 2) unit_spend from l"""


@query("cross_shop_2", _cross(["ECONOMY", "PROMO"]), 2)
def cross_shop_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.CrossShop(transactions(spark, sf_dir), "category", "ECONOMY", "PROMO").table.drop("groups")


@query("cross_shop_3", _cross(["ECONOMY", "PROMO", "SMALL"]), 2)
def cross_shop_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.CrossShop(transactions(spark, sf_dir), "category", "ECONOMY", "PROMO", "category", "category", "SMALL").table.drop("groups")


@query("cross_shop_table", _cross(["ECONOMY", "PROMO", "SMALL"]).replace("select customer_id, group_1, group_2, group_3, group_labels, round(v, 2) unit_spend from l", "select group_labels, round(sum(v), 2) unit_spend, round(sum(v) / sum(sum(v)) over () * 100, 2) percent from l group by group_labels"), 2)
def cross_shop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = ops.CrossShop(transactions(spark, sf_dir), "category", "ECONOMY", "PROMO", "category", "category", "SMALL").summary.drop("groups")
    return summary.select("group_labels", "unit_spend", (F.col("percent") * 100).alias("percent"))


_CDH = """+ , b as (select distinct customer_id c, transaction_id t, brand p from tx), m as (select t from b group by t having count(*) > 1),
    x as (select distinct c, p from b where t in (select t from m)), q as (select distinct c, p from b except select c, p from x)"""


@query("cdh_pairs", _CDH + " select c customer_id, p brand from q")
def cdh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.CustomerDecisionHierarchy(transactions(spark, sf_dir), "brand").pairs


_CDH_DISTANCES = (
    _CDH.replace("q as (select distinct c, p from b except select c, p from x)", "q as (select distinct c, {0} p from b)")
    + """, h as (select p, count(*) n from q group by p), k as (select a.p p1, b.p p2, count(*) n from q a join q b on a.c = b.c and a.p < b.p group by all),
    z as (select a.p product_1, b.p product_2, a.n n_1, b.n n_2, coalesce(k.n, 0) "both", (select count(distinct c) from q) t from h a join h b on a.p < b.p {1} join k on k.p1 = a.p and k.p2 = b.p),
    y as (select *, cast("both" as double) * (t - n_1 - n_2 + "both") u, cast(n_1 - "both" as double) * (n_2 - "both") w from z)
    select product_1, product_2, n_1, n_2, "both", round(coalesce((u - w) / nullif(u + w, 0), 0), 6) yules_q, round((2 - coalesce((u - w) / nullif(u + w, 0), 0)) / 2, 6) distance from y"""
)


@query("cdh_distances", _CDH_DISTANCES.format("p", "left"), 6)
def cdh_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.CustomerDecisionHierarchy(transactions(spark, sf_dir), "brand", exclude_same_transaction_products=False).complete()


@query("cdh_met_pairs", _CDH_DISTANCES.replace("brand p", "store_id p").format("p", ""), 6)
def cdh_met_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.CustomerDecisionHierarchy(transactions(spark, sf_dir), "store_id", exclude_same_transaction_products=False).table


# ---- time

_COHORT = """+ , r as (select customer_id c, cast(date_trunc('{1}', transaction_date) as date) p, {0} v from tx), f as (select c, min(p) a from r group by c),
    k as (select a, cast({3} as int) s, {2} x from r join f using (c) group by a, p), g as (select min(a) lo, max(a) hi, max(s) m from k),
    d as (select cast(unnest(generate_series(lo, hi, interval {4})) as date) a, m from g), e as (select a, unnest(range(0, m + 1)) s from d)"""


@query(
    "cohort_month_long",
    _COHORT.format("customer_id", "month", "count(distinct v)", "date_diff('month', a, p)", "1 month") + " select a min_period_shopped, cast(e.s as int) period_since, coalesce(x, 0) period_value from e left join k using (a, s)",
)
def cohort_month_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.CohortAnalysis(transactions(spark, sf_dir), "customer_id").table


@query(
    "cohort_week_sum",
    _COHORT.format("unit_quantity", "week", "sum(v)", "date_diff('day', a, p) / 7", "7 days") + " select a min_period_shopped, cast(e.s as int) period_since, round(coalesce(x, 0), 2) period_value from e left join k using (a, s)",
    2,
)
def cohort_week_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.CohortAnalysis(transactions(spark, sf_dir), "unit_quantity", "sum", "week").table


@query(
    "cohort_pct",
    _COHORT.format("customer_id", "quarter", "count(distinct v)", "date_diff('quarter', a, p)", "3 months")
    + """ select a min_period_shopped, cast(e.s as int) period_since, coalesce(round_even(k.x / nullif(b.x, 0), 2), 0) period_value from e left join k using (a, s) left join (select a, x from k where s = 0) b using (a)""",
)
def cohort_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.CohortAnalysis(transactions(spark, sf_dir), "customer_id", period="quarter", percentage=True).table


@query("purchases_per_customer", "+ select customer_id, count(distinct transaction_id) transactions from tx group by customer_id")
def purchases_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.PurchasesPerCustomer(transactions(spark, sf_dir)).table


@query(
    "purchases_percentile",
    "+ , p as (select count(distinct transaction_id) n from tx group by customer_id) select round(unnest([0.25, 0.5, 0.9]::double[]), 4) share, round(unnest(quantile_cont(n, [0.25, 0.5, 0.9])), 4) \"value\" from p",
)
def purchases_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.PurchasesPerCustomer(transactions(spark, sf_dir)).percentile_table(0.25, 0.5, 0.9)


@query("purchase_share", "+ , p as (select count(distinct transaction_id) n from tx group by customer_id) select round(avg(case when n > 10 then 1.0 else 0.0 end), 6) share from p", 6)
def purchase_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.PurchasesPerCustomer(transactions(spark, sf_dir)).share_table(10, "greater_than")


@query("days_between", "+ , d as (select customer_id, count(distinct transaction_date) n, min(transaction_date) a, max(transaction_date) b from tx group by customer_id) select customer_id, round(date_diff('day', a, b) / (n - 1), 4) \"diff\" from d where n > 1")
def days_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.DaysBetweenPurchases(transactions(spark, sf_dir)).table


@query(
    "days_between_percentile",
    "+ , d as (select customer_id, count(distinct transaction_date) n, min(transaction_date) a, max(transaction_date) b from tx group by customer_id) select 0.5::double share, round(quantile_cont(date_diff('day', a, b) / (n - 1), 0.5), 4) \"value\" from d where n > 1",
)
def days_between_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.DaysBetweenPurchases(transactions(spark, sf_dir)).percentile_table(0.5)


_CHURN = """+ , d as (select distinct customer_id c, transaction_date d from tx),
    v as (select d, row_number() over w n, lead(d) over w is null l from d window w as (partition by c order by d)),
    t as (select n transaction_number, nullif(count(*) filter (not l), 0) retained, nullif(count(*) filter (l), 0) churned from v where date_diff('day', d, (select max(d) from d)) > 180 group by n)"""


@query("churn", _CHURN + " select cast(transaction_number as int) transaction_number, retained, churned, round(churned / (coalesce(retained, 0) + churned), 4) churned_pct from t")
def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.TransactionChurn(transactions(spark, sf_dir), 180).table


@query("churn_cumulative", _CHURN + " select cast(transaction_number as int) transaction_number, round(sum(coalesce(churned, 0)) over (order by transaction_number) / (select count(distinct c) from d), 4) cumulative_churn from t")
def churn_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.TransactionChurn(transactions(spark, sf_dir), 180).cumulative()


# ---- two periods

_GL = """+ , a as (select {0}, {1}), g as (select * from a where abs(focus_p1) + abs(focus_p2) + abs(comparison_p1) + abs(comparison_p2) + abs(total_p1) + abs(total_p2) != 0),
    h as (select *, focus_p2 - focus_p1 focus_diff, comparison_p2 - comparison_p1 comparison_diff, total_p2 - total_p1 total_diff from g),
    i as (select *, focus_p1 = 0 and comparison_p1 = 0 n, not (focus_p1 = 0 and comparison_p1 = 0) and focus_p2 = 0 and comparison_p2 = 0 z,
      case when focus_diff > 0 then case when comparison_diff > 0 then focus_diff else greatest(0, focus_diff + comparison_diff) end when comparison_diff < 0 then focus_diff else least(0, focus_diff + comparison_diff) end o from h),
    j as (select * replace (case when n or z then 0 else o end as o), case when n or z then 0 else focus_diff - o end m from i),
    k as (select * exclude (n, z, o, m), case when n then focus_p2 else 0 end "new", case when z then -focus_p1 else 0 end lost, greatest(o, 0) increased_focus, least(o, 0) decreased_focus,
      greatest(m, 0) switch_from_comparison, least(m, 0) switch_to_comparison from j)"""
_GL_CELLS = ", ".join(
    f"coalesce(sum(unit_spend) filter ({w} \"year\" = {y}), 0) {g}_{p}" for p, y in (("p1", 1998), ("p2", 1999)) for g, w in (("focus", "category = 'ECONOMY' and"), ("comparison", "category = 'STANDARD' and"), ("total", ""))
)
_GL_COLUMNS = [f"{g}_{p}" for p in ("p1", "p2", "diff") for g in ("focus", "comparison", "total")] + ["new", "lost", "increased_focus", "decreased_focus", "switch_from_comparison", "switch_to_comparison"]


def _gain_loss_sql(keys: str, select: str) -> str:
    return _GL.format(keys, _GL_CELLS + f' from tx where "year" in (1998, 1999) group by {keys}') + select


def _gain_loss(spark: SparkSession, sf_dir: str, group: str | None = None) -> ops.GainLoss:
    return ops.GainLoss(transactions(spark, sf_dir), "year = 1998", "year = 1999", "category = 'ECONOMY'", "Economy", "category = 'STANDARD'", "Standard", group_col=group)


@query("gain_loss_customer", _gain_loss_sql("customer_id", " select customer_id, " + ", ".join(f'round("{c}", 2) "{c}"' for c in _GL_COLUMNS) + " from k"), 2)
def gain_loss_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gain_loss(spark, sf_dir).table


@query("gain_loss_table", _gain_loss_sql("customer_id", " select " + ", ".join(f'round(sum("{c}"), 2) "{c}"' for c in _GL_COLUMNS) + " from k"), 2)
def gain_loss_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gain_loss(spark, sf_dir).summary


@query("gain_loss_grouped", _gain_loss_sql("brand, customer_id", " select brand, " + ", ".join(f'round(sum("{c}"), 2) "{c}"' for c in _GL_COLUMNS) + " from k group by brand"), 2)
def gain_loss_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gain_loss(spark, sf_dir, "brand").summary


def _tree_sql(keys: str) -> str:
    lead = f"{keys}, " if keys else ""
    base = {"spend": "sum(unit_spend)", "customers": "count(distinct customer_id)", "transactions": "count(distinct transaction_id)", "units": "sum(unit_quantity)"}
    cells = ", ".join(f'cast(coalesce({f} filter ("year" = {y}), 0) as double) {n}_{p}' for n, f in base.items() for p, y in (("p1", 1998), ("p2", 1999)))
    ratios = {"spend_per_customer": ("spend", "customers"), "spend_per_transaction": ("spend", "transactions"), "transactions_per_customer": ("transactions", "customers"), "units_per_transaction": ("units", "transactions"), "price_per_unit": ("spend", "units")}
    r = ", ".join(f"coalesce({a}_{p} / nullif({b}_{p}, 0), 0) {n}_{p}" for n, (a, b) in ratios.items() for p in ("p1", "p2"))
    names = [*base, *ratios]
    d = ", ".join(f"{n}_p2 - {n}_p1 {n}_diff, ({n}_p2 - {n}_p1) / nullif({n}_p1, 0) {n}_pct_diff, ({n}_p2 - {n}_p1) / nullif(({n}_p1 + {n}_p2) / 2, 0) {n}_mid" for n in names)
    half = lambda w, a, b: f"({w}_p2 - {a}_p1 * {b}_p2 - {a}_diff * {b}_diff / 2)"
    mixed = "customers_diff * spend_per_customer_diff"
    c = {
        "customers": half("spend", "customers", "spend_per_customer"),
        "spend_per_customer": half("spend", "spend_per_customer", "customers"),
        "transactions_per_customer": half("spend_per_customer", "transactions_per_customer", "spend_per_transaction") + f" * customers_p2 - {mixed} / 4",
        "spend_per_transaction": half("spend_per_customer", "spend_per_transaction", "transactions_per_customer") + f" * customers_p2 - {mixed} / 4",
        "price_per_unit": f"({half('spend_per_transaction', 'price_per_unit', 'units_per_transaction')} * transactions_per_customer_p2 - transactions_per_customer_diff * spend_per_transaction_diff / 4) * customers_p2 - {mixed} / 8",
        "units_per_transaction": f"({half('spend_per_transaction', 'units_per_transaction', 'price_per_unit')} * transactions_per_customer_p2 - transactions_per_customer_diff * spend_per_transaction_diff / 4) * customers_p2 - {mixed} / 8",
    }
    shown = ", ".join(f"round({n}_{e}, 3) {n}_{e}" for n in names for e in ("p1", "p2", "diff", "pct_diff"))
    contributions = ", ".join(f"round({e}, 3) {n}_contrib" for n, e in c.items())
    return f"""+ , a as (select {lead}{cells} from tx where "year" in (1998, 1999) {"group by " + keys if keys else ""}), b as (select *, {r} from a), d as (select *, {d} from b)
    select {lead}{shown}, round(transactions_per_customer_mid / nullif(spend_per_customer_mid, 0), 3) frequency_elasticity, round(units_mid / nullif(price_per_unit_mid, 0), 3) price_elasticity, {contributions} from d"""


@query("revenue_tree", _tree_sql(""), 3)
def revenue_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.RevenueTree(transactions(spark, sf_dir), "year", 1998, 1999).table


@query("revenue_tree_grouped", _tree_sql("segment_name, category"), 3)
def revenue_tree_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.RevenueTree(transactions(spark, sf_dir), "year", 1998, 1999, ["segment_name", "category"]).table


# ---- chart data


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumnRenamed("ts", "transaction_date")


@query("time_agg", "+ select cast(date_trunc('month', transaction_date) as date) period_start, segment_name, round(sum(unit_spend), 2) \"value\" from tx group by all", 2)
def time_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.time_series(transactions(spark, sf_dir), "unit_spend", "M", group_col="segment_name")


_ISLANDS = """with e as (select distinct {0} category, {1} p from {2}), l as (select *, coalesce(date_diff('day', lag(p) over (partition by category order by p), p) > {3}, true) g from e),
    s as (select *, sum(cast(g as int)) over (partition by category order by p) i from l) select category, min(p) segment_start, count(*) periods from s group by category, i"""


@query("broken_timeline", _ISLANDS.format("user_id", "cast(ts as date)", 'events where "value" >= 20', 1))
def broken_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.broken_timeline(_events(spark, sf_dir), "user_id", "value", threshold=20)


@query("broken_timeline_week", _ISLANDS.format("o_custkey", "cast(date_trunc('week', o_orderdate) as date)", "orders", 7))
def broken_timeline_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "transaction_date").withColumn("one", F.lit(1))
    return charts.broken_timeline(orders, "o_custkey", "one", "W")


@query("price_bands", "with b as (select p_brand \"group\", case when p_retailprice >= 900 and p_retailprice <= 1000 then 0 when p_retailprice > 1000 and p_retailprice <= 1200 then 1 when p_retailprice > 1200 and p_retailprice <= 1500 then 2 end bin from part), c as (select \"group\", bin, count(*) n from b group by all), d as (select *, n / sum(n) over (partition by \"group\") share from c) select \"group\", bin, [900.0, 1000.0, 1200.0][bin + 1]::double \"low\", [1000.0, 1200.0, 1500.0][bin + 1]::double high, round(share, 4) share from d where bin is not null")
def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.price_bands(table(spark, sf_dir, "part"), "p_retailprice", "p_brand", [900, 1000, 1200, 1500])


_HIST = "with v as (select least(greatest(l_quantity, 5), 45) x from lineitem) select cast(least(floor((x - 5) / 4), 9) as int) bin, 5 + cast(least(floor((x - 5) / 4), 9) as int) * 4.0 bin_left, 5 + (cast(least(floor((x - 5) / 4), 9) as int) + 1) * 4.0 bin_right, count(*) n from v group by all"


@query("histogram_bins", _HIST.replace("* 4.0 bin_left", "* 4.0::double bin_left").replace("* 4.0 bin_right", "* 4.0::double bin_right"))
def histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.histogram_bins(table(spark, sf_dir, "lineitem"), "l_quantity", 10, 5, 45)


@query("histogram_cumulative", "with v as (select l_returnflag \"group\", cast(least(floor((l_quantity - 10) / 5), 5) as int) bin, count(*) n from lineitem where l_quantity between 10 and 40 group by all) select \"group\", bin, 10 + bin * 5::double bin_left, 10 + (bin + 1) * 5::double bin_right, cast(sum(n) over (partition by \"group\" order by bin) as bigint) n from v")
def histogram_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.histogram_bins(table(spark, sf_dir, "lineitem"), "l_quantity", 6, 10, 40, "fillna", "l_returnflag", cumulative=True)


@query(
    "period_on_period",
    """+ select '1998-01-01 to 1998-03-31' period, transaction_date aligned_date, round(sum(unit_spend), 2) "value" from tx where transaction_date between date '1998-01-01' and date '1998-03-31' group by all
    union all select '2000-01-01 to 2000-03-31', cast(transaction_date - interval 2 year as date), round(sum(unit_spend), 2) from tx where transaction_date between date '2000-01-01' and date '2000-03-31' group by cast(transaction_date - interval 2 year as date)""",
    2,
)
def period_on_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.period_on_period(transactions(spark, sf_dir), "unit_spend", [("1998-01-01", "1998-03-31"), ("2000-01-01", "2000-03-31")])


@query(
    "waterfall_base",
    """+ , y as (select "year" "position", sum(case when on_promotion then -unit_quantity else unit_quantity end) amount from tx group by 1)
    select "position", round(amount, 2) amount, round(coalesce(sum(amount) over (order by "position" rows between unbounded preceding and 1 preceding), 0), 2) base, round(amount / nullif(sum(amount) over (), 0) * 100, 2) share from y where amount != 0""",
    2,
)
def waterfall_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    amounts = transactions(spark, sf_dir).groupBy("year").agg(F.sum(F.when(F.col("on_promotion"), -F.col("unit_quantity")).otherwise(F.col("unit_quantity"))).alias("net"))
    return charts.waterfall_steps(amounts, "year", "net")


@query(
    "bar_shares",
    """+ , w as (select segment_name x, sum(unit_spend) spend, sum(unit_spend * discount) rebate from tx group by 1), u as (select x, 'spend' series, spend "value" from w union all select x, 'rebate', rebate from w)
    select x, series, round("value", 2) "value", round("value" / nullif(sum("value") over (partition by series), 0) * 100, 2) share from u""",
    2,
)
def bar_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = transactions(spark, sf_dir).groupBy("segment_name").agg(F.sum("unit_spend").alias("spend"), F.sum(F.col("unit_spend") * F.col("discount")).alias("rebate"))
    return charts.bar_shares(sums, "segment_name", ["spend", "rebate"], "series")


def _fit(x: str, y: str, guess: str, shown: str, where: str) -> str:
    return f"""with r as (select p_size::double x, p_retailprice::double y from part where {where}), f as (select regr_slope({y}, {x}) m, regr_intercept({y}, {x}) c, avg(y) a from r)
    select round(any_value(m), 6) slope, round(any_value({shown}), 6) intercept, round(1 - sum(pow(y - {guess}, 2)) / nullif(sum(pow(y - a, 2)), 0), 6) r_squared from r, f"""


@query("regression_linear", _fit("x", "y", "(c + m * x)", "c", "true"), 6)
def regression_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.regression(table(spark, sf_dir, "part"), "p_size", "p_retailprice")


@query("regression_power", _fit("ln(x)", "ln(y)", "exp(c + m * ln(x))", "exp(c)", "p_size > 0 and p_retailprice > 0"), 6)
def regression_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.regression(table(spark, sf_dir, "part"), "p_size", "p_retailprice", "power")


@query("regression_logarithmic", _fit("ln(x)", "y", "(c + m * ln(x))", "c", "p_size > 0"), 6)
def regression_logarithmic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.regression(table(spark, sf_dir, "part"), "p_size", "p_retailprice", "logarithmic")


@query("regression_exponential", _fit("x", "ln(y)", "exp(c + m * x)", "exp(c)", "p_retailprice > 0"), 6)
def regression_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.regression(table(spark, sf_dir, "part"), "p_size", "p_retailprice", "exponential")


@query(
    "segment_joined_back",
    """+ , v as (select customer_id, sum(unit_spend) s from tx group by customer_id), r as (select customer_id, percent_rank() over (order by s, customer_id) p from v where s != 0)
    select case when p <= .5 then 'Light' when p <= .8 then 'Medium' else 'Heavy' end level, "year", round(sum(unit_spend), 2) spend from tx join r using (customer_id) group by all""",
    2,
)
def segment_joined_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    level = ops.HMLSegmentation(tx, zero_value_customers="exclude").table.select("customer_id", F.col("segment_name").alias("level"))
    return tx.join(level, "customer_id", "left").groupBy("level", "year").agg(F.sum("unit_spend").alias("spend"))


@query(
    "composite_rank_max",
    """+ , c as (select customer_id, segment_name, max(transaction_date) latest, cast(sum(cast(unit_quantity as bigint)) as bigint) units from tx group by all),
    r as (select *, rank() over (order by latest desc) latest_rank, rank() over (order by segment_name) segment_name_rank, rank() over (order by units desc) units_rank from c)
    select *, greatest(latest_rank, segment_name_rank, units_rank) composite_rank from r""",
)
def composite_rank_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = transactions(spark, sf_dir).groupBy("customer_id", "segment_name").agg(F.max("transaction_date").alias("latest"), F.sum(F.col("unit_quantity").cast("long")).alias("units"))
    return ops.CompositeRank(by, [("latest", "desc"), "segment_name", ("units", "desc")], "max").table


_COHORT_YEAR = _COHORT.format("customer_id", "year", "count(distinct v)", "date_diff('year', a, p)", "1 year")


@query("cohort_wide", _COHORT_YEAR + " , l as (select a min_period_shopped, e.s, coalesce(x, 0) x from e left join k using (a, s)) select * from (pivot l on s using any_value(x) group by min_period_shopped)")
def cohort_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.CohortAnalysis(transactions(spark, sf_dir), "customer_id", period="year").wide()


@query(
    "cohort_labels",
    _COHORT_YEAR + " select a min_period_shopped, cast(e.s as int) period_since, coalesce(round_even(k.x / nullif(b.x, 0), 2), 0) period_value, cast(cast(round(coalesce(round_even(k.x / nullif(b.x, 0), 2), 0) * 100) as int) as varchar) || '%' \"label\" from e left join k using (a, s) left join (select a, x from k where s = 0) b using (a)",
)
def cohort_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.cohort_labels(ops.CohortAnalysis(transactions(spark, sf_dir), "customer_id", period="year", percentage=True).table, percentage=True)


_BY_YEAR = """+ , y as (select "year" x, segment_name, round(sum(unit_spend), 2) v from tx group by all)"""


def _by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).groupBy("year", "segment_name").agg(F.sum("unit_spend").alias("spend"))


@query("line_series", _BY_YEAR + " select * from (pivot y on segment_name using any_value(v) group by x)", 2)
def line_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.line_series(_by_year(spark, sf_dir), "year", "spend", "segment_name", ["BUILDING"])


@query("area_series", """+ , y as (select "year" x, sum(unit_spend) spend, sum(unit_spend * discount) rebate from tx group by 1) select x, round(coalesce(spend, 0), 2) spend, round(coalesce(rebate, 0), 2) rebate from y""", 2)
def area_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = transactions(spark, sf_dir).groupBy("year").agg(F.sum("unit_spend").alias("spend"), F.sum(F.col("unit_spend") * F.col("discount")).alias("rebate"))
    return charts.area_series(sums, "year", ["spend", "rebate"])


@query(
    "scatter_points",
    """+ , p as (select brand, category, sum(unit_quantity) units, sum(unit_spend) spend, count(distinct customer_id) people from tx group by all)
    select category series, round(people * 0.5, 2) size, brand "label", round(units, 2) x, round(spend, 2) y from p""",
    2,
)
def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = transactions(spark, sf_dir).groupBy("brand", "category").agg(F.sum("unit_quantity").alias("units"), F.sum("unit_spend").alias("spend"), F.count_distinct("customer_id").alias("people"))
    return charts.scatter_points(by, "units", "spend", "people", 0.5, "brand", "category")


@query("venn_sets", _cross(["ECONOMY", "PROMO", "SMALL"]).replace("select customer_id, group_1, group_2, group_3, group_labels, round(v, 2) unit_spend from l", "select group_labels, round(sum(v) / sum(sum(v)) over (), 4) area from l group by group_labels") + " qualify group_labels != 'No Groups'")
def venn_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.venn_sets(ops.CrossShop(transactions(spark, sf_dir), "category", "ECONOMY", "PROMO", "category", "category", "SMALL").summary).drop("groups")


@query("index_bars", _INDEX.format("category, brand", "partition by category", "100").replace('"index" from b', '"index" from b').replace("where p is not null", "where p is not null and brand not in ('Brand#11')"))
def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.index_bars(transactions(spark, sf_dir), "BUILDING", "segment_name", "unit_spend", "brand", "category", exclude_groups=["Brand#11"])


@query(
    "index_bars_sorted",
    "+ , i as (select * from (" + _INDEX.format("brand", "", "100").replace("+ , a as", "with a as") + """)), j as ((select * from i order by "index" desc, brand limit 4) union all (select * from i order by "index", brand limit 4))
    select *, case when "index" < -1 then 'negative' when "index" > 1 then 'positive' else 'neutral' end tone from j""",
)
def index_bars_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.index_bars(transactions(spark, sf_dir), "BUILDING", "segment_name", "unit_spend", "brand", sort_by="value", ascending=False, top_n=4, bottom_n=4, highlight=(99, 101))


@query("sorted_bars", """+ select segment_name x, round(sum(unit_spend), 2) spend, round(sum(unit_quantity), 2) units from tx group by 1""", 2)
def sorted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = transactions(spark, sf_dir).groupBy("segment_name").agg(F.sum("unit_spend").alias("spend"), F.sum("unit_quantity").alias("units"))
    return charts.sorted_bars(sums, "segment_name", ["spend", "units"], "descending")


# ---- sources and sinks


@query("memory_source", "select n_regionkey, count(*) nations, min(n_name) first_name from nation group by n_regionkey")
def memory_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas frame as a table."""
    return as_table(table(spark, sf_dir, "nation").toPandas(), spark).groupBy("n_regionkey").agg(F.count("*").alias("nations"), F.min("n_name").alias("first_name"))


@query("file_formats", "select kind, c_custkey, c_name, round(c_acctbal, 2) c_acctbal from customer, (values ('csv'), ('json'), ('orc'), ('parquet')) k(kind)", 2)
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written to and read from every kind of file."""
    rows, out = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), None
    for kind in ("csv", "json", "orc", "parquet"):
        uri = new_uri(spark, kind)
        write_files(rows, uri, kind)
        back = read_files(spark, uri, kind, rows.schema.simpleString()[len("struct<") : -1].replace(":", " ") if kind in ("csv", "json") else None)
        back = back.select(F.lit(kind).alias("kind"), *rows.columns)
        out = back if out is None else out.unionByName(back)
    return out


_WINDOWS = ", ".join(f"(date '{y}-11-01', date '{y + 1}-01-31')" for y in range(1995, 1998))


@query("overlapping_periods", f"+ select a period_start, count(*) n, round(sum(unit_spend), 2) spend from tx join (values {_WINDOWS}) p(a, b) on transaction_date between a and b group by a", 2)
def overlapping_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same season of every year, found from its first start and last end."""
    windows = {a: (a, b) for a, b in ops.find_overlapping_periods("1995-11-01", "1998-01-31")}
    rows = ops.filter_and_label_by_periods(transactions(spark, sf_dir), windows)
    return rows.groupBy(F.col("period_name").cast("date").alias("period_start")).agg(F.count("*").alias("n"), F.sum("unit_spend").alias("spend"))
