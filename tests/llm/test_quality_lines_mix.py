"""Line dedup, quality classifier and source mixing against brute force, with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import line_dedup, mixing, quality, queries

SMALL = "/root/testdata/sf0.001"
LONG = "word " * 40_000


def brute_lines(texts, min_docs, min_chars=1):
    lines = [(t or "").split("\n") for t in texts]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = Counter(k for doc in lines for k in {key(x) for x in doc} if len(k) >= min_chars)
    return [(len(doc), sum(held[key(x)] >= min_docs for x in doc), "\n".join(x for x in doc if held[key(x)] < min_docs)) for doc in lines]


@pytest.mark.parametrize("min_chars", [1, 4])
def test_lines(spark, min_chars):
    texts = ["a\nb\n\nÄ x", " A \n\nc", None, "", "\tA\nlonger line\n", "\n\n\n", "A\x0b\nİ\nlonger LINE", LONG + "\na", "longer line", "longer line"]
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string").withColumns({c: F.lit("y") for c in ("_block", "_lines", "_dropped", "part", "keys", "place")})
    found = line_dedup.drop_lines(df, min_docs=3, min_chars=min_chars)
    assert found.columns == ["doc_id", "text", "block", "_block", "part", "keys", "place", "_lines", "_dropped"]
    got = {r.doc_id: (r._lines, r._dropped, r.text, r.block) for r in found.collect()}
    want = brute_lines(texts, 3, min_chars)
    assert got == {(i if i else None): (*w, "x") for i, w in enumerate(want)}


def test_lines_of_an_empty_table(spark):
    assert line_dedup.drop_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_are_documents_of_their_own(spark):
    df = spark.createDataFrame([(1, "same")] * 3 + [(2, "other")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in line_dedup.drop_lines(df, min_docs=3).collect())
    assert got == [(1, "")] * 3 + [(2, "other")]


def test_overfull_blocks_are_dealt_into_parts(spark, monkeypatch):
    """A third of all rows is one row, repeated; the result is the same."""
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", 20)
    texts = ["common\nown\n"] * 400 + [f"common\nline {i % 300}\nno {i}" for i in range(800)]
    df = spark.createDataFrame([(0 if i < 400 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = Counter((r._lines, r._dropped, r.text) for r in line_dedup.drop_lines(df, min_docs=3).collect())
    assert got == Counter(brute_lines(texts, 3))


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 20_000, dtype=np.uint64))
    table = line_dedup.build(keys, np.arange(len(keys)))
    assert sorted(line_dedup.look(table, keys)) == list(range(len(keys)))
    assert (line_dedup.count_of(table, keys) == np.arange(len(keys))).all()
    others = np.setdiff1d(np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64), keys)
    assert (line_dedup.count_of(table, others) > 0).mean() < 1e-3
    assert (line_dedup.count_of(line_dedup.build(keys[:0], keys[:0]), keys) == 0).all()


def test_lines_oracle(spark):
    got = queries.op8_line_dedup(spark, SMALL).toPandas().sort_values("doc_id", ignore_index=True)
    con = duckdb.connect()
    con.execute(f"create view documents as from '{SMALL}/documents.parquet'")
    want = con.execute(queries.OP8_SQL).df().sort_values("doc_id", ignore_index=True)
    assert (got == want[got.columns]).all().all()


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    out = got[got.held_out]
    good, bad = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.99
    assert (out[out.quality == 1].predicted == 1).mean() > 0.99
    assert (out.predicted == out.quality).mean() > 0.95
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()


def test_quality_with_odd_rows(spark):
    docs = spark.createDataFrame([(i, "fine words here" if i % 2 else "### %%% !!!", "y") for i in range(60)] + [(None, "x", "y"), (100, None, "y"), (101, "", "y"), (102, LONG, "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (100, None), (3, 1), (102, 1)], "doc_id long, quality int")
    scored = quality.score_documents(docs, quality.fit(docs, labels), to="s").toPandas()
    assert len(scored) == 64 and scored.s.between(0, 1).all() and set(scored.score) == {"y"}
    assert scored[scored.doc_id == 1].s.item() > 0.5 > scored[scored.doc_id == 2].s.item()
    none = quality.fit(docs, labels.limit(0))
    assert set(quality.score_documents(docs, none, to="s").toPandas().s) == {0.5}
    assert quality.score_documents(docs.limit(0), none, to="s").count() == 0


def brute_scores(train, texts, epochs):
    """A plain loop of follow-the-regularised-leader over dictionaries; train: lists of (text, label), one for each shard."""
    top = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & top
        return x ^ (x >> 31)

    def features(text):
        tokens = [xxhash.xxh64_intdigest(t) for w in (text or "").encode().lower().split() for t in re.findall(rb"[\w\x80-\xff]+|[^\w\s\x80-\xff]+", w)]
        pairs = [0xD1B54A32D192ED03 if a == b else (a * 0x9E3779B97F4A7C15 + b) & top for a, b in zip(tokens, tokens[1:], strict=False)]
        n = Counter(mixed(x) >> 44 for x in (*tokens, *pairs))
        return {k: c / math.sqrt(max(1, len(tokens))) for k, c in n.items()}

    def weight(z, n):
        return 0.0 if abs(z) <= quality.L1 else -(z - math.copysign(quality.L1, z)) / ((quality.BETA + math.sqrt(n)) / quality.ALPHA + quality.L2)

    total = Counter()
    for rows in train:
        z, n = Counter(), Counter()
        for _ in range(epochs):
            for text, label in rows:
                x = features(text) | {"bias": 1.0}
                w = {k: weight(z[k], n[k]) for k in x}
                p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
                for k, v in x.items():
                    g = (p - label) * v
                    z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA * w[k]
                    n[k] += g * g
        for k in z:
            total[k] += weight(z[k], n[k]) / len(train)
    return [1 / (1 + math.exp(-sum(total[k] * v for k, v in (features(t) | {"bias": 1.0}).items()))) for t in texts]


def test_quality_equals_a_plain_loop(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    rows = rows.select("text", "quality", F.pmod(F.xxhash64("doc_id"), F.lit(quality.SHARDS)).alias("s"), F.xxhash64(F.lit(7), "doc_id").alias("o")).orderBy("s", "o").collect()
    train = [[(r.text, r.quality) for r in rows if r.s == k] for k in range(quality.SHARDS)]
    got = quality.score_documents(docs, quality.fit(docs, labels)).orderBy("doc_id").limit(60).collect()
    want = brute_scores(train, [r.text for r in got], quality.EPOCHS)
    assert max(abs(r.score - w) for r, w in zip(got, want, strict=True)) < 1e-5


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        stopped = {s for s in open_ if share * weight[s] > most * sizes[s]}
        if not stopped:
            return target | {s: share * weight[s] for s in open_}
        target |= {s: most * sizes[s] for s in stopped}
        left -= sum(most * sizes[s] for s in stopped)
        open_ -= stopped
    return target


@pytest.mark.parametrize("seed", range(2))
def test_mix(spark, seed):
    draw = np.random.default_rng(seed)
    sources = ["b", "B", "é", None, "zz", "tiny"]
    rows = [(int(i), str(draw.choice(sources[:-1], p=[0.5, 0.2, 0.1, 0.1, 0.1])) if draw.random() > 0.1 else None, "w " * int(draw.integers(0, 60))) for i in range(600)]
    rows += [(1000, "tiny", "w w w"), (1001, "empty", None), (1002, "empty", ""), (None, "b", "a b"), (7, rows[7][1], rows[7][2]), (1003, "b", LONG)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("target", F.lit("mine"))
    got = mixing.copies(df).toPandas()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    target = brute_targets(dict(sizes))
    got["source"] = got.source.astype(object).where(got.source.notna(), None)
    for s, part in got.groupby("source", dropna=False):
        s = None if s is None or s != s else s
        assert (part.source_size == sizes[s]).all()
        assert math.isclose(part.target.iloc[0], target[s], rel_tol=1e-9, abs_tol=1e-9)
        assert abs((part.copies * part["size"]).sum() - target[s]) <= part["size"].max()
        assert part.copies.max() <= 3
    again = mixing.copies(df).toPandas()
    order = ["doc_id", "source", "size", "copies"]
    assert sorted(map(str, got[order].values.tolist())) == sorted(map(str, again[order].values.tolist()))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    taken, largest = Counter(), Counter()
    for r in mixed.collect():
        taken[r.source] += len((r.text or "").split())
    for _, s, t in rows:
        largest[s] = max(largest[s], len((t or "").split()))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)


def test_mix_of_repeated_rows_and_clashing_names(spark):
    """A third of all rows is one row; columns that are called as the operator's own come out as they were."""
    rows = [(5, "a", "w w w", i) for i in range(300)] + [(10 + i, "ab"[i % 2], "w " * (i % 7), i) for i in range(600)]
    names = ["_size", "_key", "_at", "_n", "_copies", "_copy", "row", "size", "n", "copy", "rest", "copies"]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, own long").withColumns({c: F.lit(c) for c in names}).repartition(4, "own")
    slim = mixing.copies(df).toPandas()
    for _, part in slim.groupby("source"):
        assert abs((part.copies * part["size"]).sum() - part.target.iloc[0]) <= part["size"].max()
    same = slim[slim.doc_id == 5].copies
    assert len(same) == 300 and same.max() - same.min() <= 1
    mixed = mixing.mix(df).toPandas()
    assert list(mixed.columns) == df.columns and all((mixed[c] == c).all() for c in names)
    assert mixed.groupby(["doc_id", "own"]).size().max() <= 3
    again = mixing.mix(df.repartition(7)).toPandas()
    assert sorted(mixed[mixed.doc_id != 5].own) == sorted(again[again.doc_id != 5].own) and len(again) == len(mixed)


def test_mix_keeps_expectation():
    draw = np.random.default_rng(3)
    size, share = draw.integers(1, 50, 40).astype(float), np.full(40, 0.3)
    taken = np.mean([mixing.pivot(share, size, draw.random(40)) for _ in range(4000)], axis=0)
    assert np.abs(taken - 0.3).max() < 0.05
    one = mixing.pivot(share, size, draw.random(40))
    assert math.isclose((one * size).sum(), (share * size).sum()) and ((one > 0) & (one < 1)).sum() <= 1


def test_mix_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.copies(df).count() == 0 and mixing.mix(df).count() == 0


def test_digest(spark):
    row = spark.createDataFrame([("é\n",)], "text string").select(line_dedup.sha256_hex(F.col("text")).alias("x")).first()
    assert row.x == hashlib.sha256("é\n".encode()).hexdigest()
