"""python -m tidewater [--name NAME]: prints one greeting."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidewater.functions.greeting import DEFAULT, DESCRIPTION, NAME_HELP
from tidewater.operators import greeted
from tidewater.sources import one_name


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tidewater", description=DESCRIPTION)
    parser.add_argument("--name", default=DEFAULT, help=NAME_HELP)
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> None:
    name = arguments(given).name
    spark = SparkSession.builder.appName("tidewater").getOrCreate()
    print(greeted(one_name(spark, name), "name").first().greeting)


if __name__ == "__main__":
    main()
