"""Registered queries of the greeting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.greeting import DEFAULT, greet, or_default, register


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet")


def greet_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("c_custkey", greet(F.col("c_name")).alias("greeting"))


def greet_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth customer gives no name."""
    given = F.when(F.col("c_custkey") % 10 != 0, F.col("c_name"))
    return _customers(spark, sf_dir).select("c_custkey", greet(or_default(given)).alias("greeting"))


def greet_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(greet(F.lit(DEFAULT)).alias("greeting"))


def greet_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL function, over a table."""
    register(spark)
    return _customers(spark, sf_dir).selectExpr("c_custkey", "greet(c_name) as greeting", "greet() as default_greeting")


QUERIES = {"greet_table": greet_table, "greet_default": greet_default, "greet_one": greet_one, "greet_function": greet_function}
ORACLE_SQL = {
    "greet_table": "select c_custkey, 'Hello, ' || c_name || '!' as greeting from customer",
    "greet_default": "select c_custkey, 'Hello, ' || coalesce(case when c_custkey % 10 <> 0 then c_name end, 'World') || '!' as greeting from customer",
    "greet_one": "select 'Hello, ' || 'World' || '!' as greeting",
    "greet_function": "select c_custkey, 'Hello, ' || c_name || '!' as greeting, 'Hello, World!' as default_greeting from customer",
}
