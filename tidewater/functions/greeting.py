"""The greeting: a scalar string function, as a column expression and as a SQL function."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The greeting's parts and the name that is greeted when none is given.
BEFORE, AFTER, DEFAULT = "Hello, ", "!", "World"
#: The launcher's description, and the help text of its option.
DESCRIPTION, NAME_HELP = "A simple greeter.", "Name to greet"


def greet(name: Column) -> Column:
    """`Hello, <name>!` of a string column, verbatim; null for null. One native expression, no shuffle."""
    return F.concat(F.lit(BEFORE), name, F.lit(AFTER))


def or_default(name: Column) -> Column:
    """The default where no name is given (null); an empty name stays empty."""
    return F.coalesce(name, F.lit(DEFAULT))


def register(spark: SparkSession) -> None:
    """SQL function greet(name STRING DEFAULT 'World'), inlined by the optimiser."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION greet(name STRING DEFAULT '{DEFAULT}') RETURNS STRING RETURN concat('{BEFORE}', name, '{AFTER}')")
