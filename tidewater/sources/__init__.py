"""Where names come from and greetings go to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def one_name(spark: SparkSession, name: str | None) -> DataFrame:
    """One row with the column name; the value is bound as a parameter, never spliced into SQL."""
    return spark.sql("SELECT CAST(:name AS STRING) AS name", args={"name": name})


def write_lines(greetings: DataFrame, path: str, column: str = "greeting") -> None:
    """The greetings as text files, one a line; null greetings are left out."""
    greetings.select(column).where(f"{column} is not null").write.text(path)
