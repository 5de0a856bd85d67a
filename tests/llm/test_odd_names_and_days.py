"""Columns that clash with an operator's own, list entries on odd days, and labelled rows that repeat."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import fingerprints, line_dedup, quality, sentencepieces, token_counts, url_lists

# names


def test_differences_pass_other_columns_through(spark):
    texts = [(i, f"line {i}\nshared\n" * 2, f"line {i + 1}\nshared") for i in range(20)]
    df = spark.createDataFrame(texts, "id long, a text string, b text string".replace(" text", "_text"))
    for side in "ab":
        df = df.withColumn(f"{side}_keys", fingerprints.digests(F.col(f"{side}_text"))).withColumn(f"{side}_cells", fingerprints.sketch(F.col(f"{side}_keys")))
    odd = ["_s_x", "_f_x", "_open", "open", "state0", "FOUND0"]
    df = df.withColumns({c: F.lit(c) for c in odd}).withColumn("D", F.lit("gives way"))
    found = fingerprints.differences(df, {"d": ("a", "b")})
    assert found.columns == ["id", "a_text", "b_text", *odd, "d"]
    for r in found.collect():
        assert [r[c] for c in odd] == odd and sorted(x["n"] for x in r.d) == [-1, 1]


def test_added_columns_replace_those_of_the_same_name(spark):
    df = spark.createDataFrame([(1, "a b\nc", "x")], "doc_id long, text string, other string")
    cases = [
        (fingerprints.fingerprint, ["FINGERPRINT"]), (sentencepieces.encode, ["IDS"]), (line_dedup.drop_lines, ["_LINES", "_Dropped"]), (token_counts.count_tokens, ["N_TOKENS"]),
        (lambda d: quality.score_documents(d, np.zeros((1 << quality.BITS) + 1, np.float32)), ["SCORE"]),
    ]
    for operator, names in cases:
        found = operator(df.withColumns({c: F.lit("old") for c in names}))
        assert found.columns == ["doc_id", "text", "other", *(c.lower() for c in names)]
        for c in names:
            assert found.select(c).first()[0] != "old"


# days




@pytest.mark.parametrize("case", [(0, 1), (0, 2**31 - 1), (-(2**31), 2**31 - 1), (-5, 11), (7, 8), (3, 4000), (2**31 - 2, 2**31 - 1), (-(2**31), None), (0, None), (2**31 - 1, None), (100, 101)])
def test_blocks_make_up_the_interval(spark, case):
    first, end = case
    row = spark.createDataFrame([(first, end)], "a int, b int").select(url_lists.covered("a", "b").alias("x")).first()
    shift = 1 << url_lists.DAY_BITS - 1
    spans = sorted((x.node << x.level, (x.node + 1) << x.level) for x in row.x)
    assert len(spans) <= 62
    assert spans[0][0] == first + shift and spans[-1][1] == (end + shift if end is not None else 2 * shift)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def plain_hits(captures, entries):
    state = {}
    for pattern, day, listed in entries:
        state.setdefault(pattern, {})
        state[pattern][day] = state[pattern].get(day, False) or listed
    out = []
    for key, host, day in captures:
        days = [d for d in state.get(host, {}) if d <= day]
        since = max(days) if days else None
        out.append((key, since is not None and state[host][since]))
    return sorted(out)


@pytest.mark.parametrize("hot", [100_000, 7])
def test_odd_days_and_hot_hosts(spark, monkeypatch, hot):
    """Many entries without an end, captures on the first and the last day there is, and a host that half of the captures ask for on one day."""
    monkeypatch.setattr(url_lists, "HOT_ASKS", hot)
    draw = random.Random(5)
    days = [-(2**31), -1, 0, 1, 5, 31, 32, 20_260_101, 2**31 - 1]
    entries = [(f"h{i % 900}.org", draw.choice(days), draw.random() < 0.7) for i in range(10_000)]
    captures = [(i, f"h{draw.randrange(1000)}.org", draw.choice([*days, draw.randrange(100)])) for i in range(1500)] + [(i, "h3.org", 5) for i in range(1500, 3000)]
    df = spark.createDataFrame([(k, f"http://{h}/", d) for k, h, d in captures], "page_id long, url string, fetch_day int").repartition(3)
    listing = spark.createDataFrame(entries, "pattern string, day int, listed boolean")
    got = sorted((r.page_id, r.blocked) for r in url_lists.evaluate(df, listing).collect())
    assert got == plain_hits(captures, entries)


# labelled rows


def test_repeated_labelled_rows_are_learnt_once(spark, monkeypatch):
    rows = [(i, f"good plain text number {i}" if i % 2 else f"buy !!! {i} $$$") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    once = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    many = spark.createDataFrame(rows, "doc_id long, text string").union(spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(rows[7][1]).alias("text")))
    assert np.allclose(once, quality.fit(many.repartition(4), labels))


@pytest.mark.parametrize(("rows", "chars"), [(100, 10**9), (20_000, 30_000_000)])
def test_the_learner_gets_few_rows_and_characters(spark, monkeypatch, rows, chars):
    """An id with thousands of texts, and texts of a megabyte."""
    seen = []
    kept = quality.shared_table
    monkeypatch.setattr(quality, "shared_table", lambda df, name: seen.append(kept(df, name)) or seen[-1])
    long = chars < 10**9
    texts = spark.range(60 if long else 5000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit(" "), F.repeat(F.lit("ab "), 300_000 if long else 3)).alias("text"))
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    w = quality.fit(texts, labels, max_rows=rows, max_chars=chars)
    assert w.shape == ((1 << quality.BITS) + 1,)
    table = seen[0]
    n, total = table.agg(F.count("*"), F.sum("_chars")).first()
    share = min(1.0, 1.1 * rows / n, chars / total)
    left = table.where(F.pmod(F.xxhash64(F.lit(29), "doc_id", "_h"), F.lit(1_000_003)) < int(share * 1_000_003)).agg(F.count("*"), F.sum("_chars")).first()
    assert left[0] <= 1.3 * 1.1 * rows and left[1] <= 1.5 * chars


# hot lines


@pytest.mark.parametrize("most", [100_000, 1, 0])
def test_lines_of_all_documents_are_not_probed(spark, monkeypatch, most):
    """Two lines in every document and a block for nearly each of these; the answer is the same however many lines the blocks know."""
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", 1)
    monkeypatch.setattr(line_dedup, "HOT_LINES", most)
    texts = [f"everywhere\nline {i % 150}\nno {i}\n  EVERYWHERE too" for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = line_dedup.line_keys(df)
    tables, shards, counted = line_dedup.line_tables(rows)
    often = line_dedup.hot_lines(counted, 3)
    assert len(often) == (2 if most >= 2 else 0)
    got = {r.doc_id: (r._dropped, r.text) for r in line_dedup.drop_lines(df, min_docs=3).collect()}
    assert got == {i: (3, f"no {i}") for i in range(600)}
