"""Where tables come from: DataFrames, pandas, files, and the canonical transactions view."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spread import keyed, parts


def as_table(data: Any, spark: SparkSession | None = None) -> DataFrame:
    """A DataFrame as it is, a pandas frame as a DataFrame whose NaN are nulls; else a TypeError."""
    if isinstance(data, DataFrame) or (hasattr(data, "sparkSession") and hasattr(data, "schema")):
        return data
    try:
        import pandas as pd
    except ImportError:  # pandas is optional for users of DataFrames
        pd = None
    if pd is None or not isinstance(data, pd.DataFrame):
        raise TypeError("data must be a pandas or a Spark DataFrame")
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    plain = data.copy()
    for name in plain.columns:
        if isinstance(plain[name].dtype, pd.CategoricalDtype):
            plain[name] = plain[name].astype(object)
    table = spark.createDataFrame(plain)
    doubles = [f.name for f in table.schema.fields if f.dataType.typeName() in ("double", "float")]
    return table.select([F.when(F.isnan(F.col(f"`{c}`")), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c) if c in doubles else F.col(f"`{c}`") for c in table.columns])


def validate_columns(data: DataFrame, required: list[str]) -> None:
    """Missing columns are a ValueError that lists them in order; no job runs."""
    if not isinstance(required, list):
        raise TypeError("required columns must be a list")
    if missing := sorted(set(required) - set(data.columns)):
        raise ValueError(f"The following columns are required but missing: {missing}")


def read_files(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: Any) -> DataFrame:
    """Parquet, ORC, JSON or CSV files (CSV with a header, and a schema rather than inference)."""
    reader = spark.read.options(**({"header": True} if kind == "csv" else {}), **options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def write_files(data: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "error") -> None:
    """A file sink, partitioned by columns if wanted."""
    writer = data.write.mode(mode).options(**({"header": True} if kind == "csv" else {})).format(kind)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema as one transactions table with the default column names.

    Foreign keys have no gaps, so inner joins keep every line; Catalyst prunes the dimensions'
    columns and picks broadcast or sort-merge joins by their sizes.  Shuffles of large tables have as
    many partitions as the tables ask for (``plans/spread.py``).
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("transaction_id"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("store_id"),
        F.col("l_quantity").alias("unit_quantity"), F.col("l_extendedprice").alias("unit_spend"), F.col("l_discount").alias("discount"),
        (F.col("l_returnflag") == "R").alias("on_promotion"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("date").alias("transaction_date"), F.year("o_orderdate").alias("year")
    )
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment_name"), F.col("c_nationkey").alias("nation"))
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("unit_price"))
    number = parts(lines, orders, customers, products)
    return lines.join(keyed(orders, number, "transaction_id"), "transaction_id").join(keyed(customers, number, "customer_id"), "customer_id").join(keyed(products, number, "product_id"), "product_id")
