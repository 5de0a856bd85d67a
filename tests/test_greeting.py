import contextlib
import io

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewater.__main__ import arguments, main
from tidewater.functions.greeting import greet, register
from tidewater.operators import greeted
from tidewater.plans import greetings
from tidewater.sources import one_name, write_lines
from tidewater.streaming import greet_stream

SMALL = "/root/testdata/sf0.001"
CASES = [("Alice", "Hello, Alice!"), ("", "Hello, !"), (" \n", "Hello,  \n!"), ("a%s{x}", "Hello, a%s{x}!"), ("O'Brien", "Hello, O'Brien!"), (None, None)]


def test_cases(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(CASES)], "i int, name string")
    got = {r.i: r.greeting for r in greeted(df, "name").collect()}
    assert got == {i: y for i, (_, y) in enumerate(CASES)}
    assert greeted(df, "name", default=True).where("name is null").first().greeting == "Hello, World!"


def test_sql_function(spark):
    register(spark)
    row = spark.sql("select greet() a, greet('') b, greet(null) c, greet(name => 'Eve') d").first()
    assert tuple(row) == ("Hello, World!", "Hello, !", None, "Hello, Eve!")


def test_plan_is_one_projection(spark):
    df = spark.read.parquet(f"{SMALL}/customer.parquet").select(greet(F.col("c_name")).alias("greeting"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "c_acctbal" not in plan


@pytest.mark.parametrize("name", greetings.QUERIES)
def test_oracle(spark, name):
    got = greetings.QUERIES[name](spark, SMALL)
    con = duckdb.connect()
    con.execute(f"create view customer as from '{SMALL}/customer.parquet'")
    want = con.execute(greetings.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    order = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(order).collect())) == sorted(want.fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 150
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(("given", "name"), [([], "World"), (["--name", "Alice"], "Alice"), (["--name=Alice"], "Alice"), (["--na", "Alice"], "Alice"), (["--name", ""], ""), (["--name", "-5"], "-5")])
def test_arguments(given, name):
    assert arguments(given).name == name


@pytest.mark.parametrize("given", [["-n", "Alice"], ["--name"], ["Alice"], ["--other"]])
def test_wrong_arguments(given):
    with pytest.raises(SystemExit) as stopped, contextlib.redirect_stderr(io.StringIO()):
        arguments(given)
    assert stopped.value.code == 2


def test_help():
    out = io.StringIO()
    with pytest.raises(SystemExit) as stopped, contextlib.redirect_stdout(out):
        arguments(["--help"])
    assert stopped.value.code == 0 and "A simple greeter." in out.getvalue() and "Name to greet" in out.getvalue()


def test_launcher_prints_one_line(spark, capsys):
    main(["--name", "O'Brien"])
    assert capsys.readouterr().out == "Hello, O'Brien!\n"


def test_text_sink(spark, tmp_path):
    write_lines(greeted(one_name(spark, "Bo"), "name"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["Hello, Bo!"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([("Ann",), (None,)], "name string").write.parquet(str(tmp_path / "in"))
    query = greet_stream(spark, str(tmp_path / "in"), "name string", "name").writeStream.format("memory").queryName("greeted").start()
    query.processAllAvailable()
    query.stop()
    assert {r.greeting for r in spark.table("greeted").collect()} == {"Hello, Ann!", None}
