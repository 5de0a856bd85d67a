"""Near-duplicate joins, URL lists, language-model scores and the pipeline against brute force."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import components as components_module
from tidewater.llm import embedding_dedup, ngram_join, pitman_yor, queries, unigram, url_lists
from tidewater.llm.components import components, spanning

SMALL = "/root/testdata/sf0.001"


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize(("seed", "chunk"), [(0, 500_000), (1, 3), (2, 1)])
def test_components(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(components_module, "CHUNK", chunk)
    draw = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in draw.integers(0, 60, (40, 2))] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups({x for p in links for x in p if p[0] != p[1]}, [p for p in links if p[0] != p[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(
    "links",
    [[], [(3, 3)], [(1, 2), (2, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 90)], [(500, i) for i in range(90)]],
    ids=["none", "loop", "twice", "chain", "star", "star around the largest"],
)
def test_components_of_shapes(spark, links):
    found = components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()
    linked = [x for x in links if x[0] != x[1]]
    whole = groups({v for x in linked for v in x}, linked)
    assert {r["node"]: r["component"] for r in found} == whole
    assert len(found) == len(whole)


def test_spanning():
    i, j = np.array([0, 1, 2, 4, 3]), np.array([1, 2, 0, 5, 3])
    assert spanning(6, i, j).tolist() == [0, 1, 3]


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_groups(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    return {i: len(s) for i, s in sets}, groups([i for i, _ in sets], links)


def family(draw, base, copies, edits):
    out = []
    for _ in range(copies):
        words = list(base)
        for k in draw.integers(0, len(words), draw.integers(0, edits + 1)):
            words[k] = f"e{draw.integers(0, 10**9)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("seed", "frequent", "broadcast", "rounds"), [(0, 2, 1000, 3), (1, 1, 100_000, 2), (2, 0, 0, 1), (3, 3, 100_000, 9)])
def test_ngram_groups(spark, monkeypatch, seed, frequent, broadcast, rounds):
    """With a low bound almost all shingles are indexed by pairs; small tiles split the large groups; without broadcasts the joins shuffle."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(ngram_join, "BROADCAST_SHINGLES", broadcast)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "TILE", 16)
    draw = np.random.default_rng(seed)
    base = lambda n: [f"w{x}" for x in draw.integers(0, 10**6, n)]
    texts = family(draw, base(60), 70, 4) + family(draw, base(200), 15, 8) + family(draw, base(8), 12, 1) + [" ".join(base(int(n))) for n in draw.integers(1, 80, 40)]
    shared = base(50)
    texts += [" ".join(base(5) + shared + base(int(n))) for n in draw.integers(0, 20, 30)]
    texts += ["A b C d E", "a B c d e", "a b c d", "a b c d", "one", "ONE", "", None, " \n\t", "x y " * 3000, "x y " * 2999, texts[0], texts[0].upper()]
    rows = list(enumerate(texts, 10))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))).collect()}
    sizes, comps = brute_groups(rows)
    assert got == {i: (sizes[i], comps[i]) for i, _ in rows}


def test_ngram_groups_with_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (7, None), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (5, 2, 1), (7, 0, 7), (None, 0, None)], key=str)
    assert ngram_join.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ngram_groups_of_rows_that_share_an_id(spark):
    """A row's own text decides: id 1 stands for two unrelated texts, which must not join what is similar to either."""
    a, b = [f"a{i}" for i in range(60)], " ".join(f"b{i}" for i in range(60))
    rows = [(0, " ".join(a)), (1, " ".join([*a[:59], "x"])), (1, b), (5, b), (6, b + " end")]
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 0), (1, 1), (5, 1), (6, 1)]


def test_ngram_candidates_share_as_much_as_they_need(spark, monkeypatch):
    """A rare phrase that two long texts share makes no candidates, so that a chain of such texts is no cluster that is compared whole; near copies among them are found."""
    clusters, links = [], ngram_join._links

    def kept(sets, found):
        clusters.extend(r.node for r in found.collect())
        return links(sets, found)

    monkeypatch.setattr(ngram_join, "_links", kept)
    draw = np.random.default_rng(9)
    phrases = [[f"p{k}x{i}" for i in range(10)] for k in range(41)]
    texts = [" ".join([*phrases[k], *(f"w{x}" for x in draw.integers(0, 10**9, 580)), *phrases[k + 1]]) for k in range(40)]
    rows = list(enumerate([*texts, *(x.rsplit(" ", 40)[0] for x in texts[:3])], 1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sizes, comps = brute_groups(rows)
    assert got == {i: (sizes[i], comps[i]) for i, _ in rows} and len(set(comps.values())) == 40
    assert len(clusters) == 6


@pytest.mark.parametrize("seed", [4, 5])
def test_ngram_rounds_without_lists_of_nodes(spark, monkeypatch, seed):
    """Where too many nodes remain or repeat to be sent, nodes tell by themselves whether they remain."""
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    draw = np.random.default_rng(seed)
    base = lambda n: [f"w{x}" for x in draw.integers(0, 10**6, n)]
    shared = base(60)
    texts = family(draw, base(300), 12, 30) + family(draw, base(90), 9, 9) + [" ".join(base(20) + shared + base(int(n))) for n in draw.integers(0, 40, 30)]
    rows = list(enumerate([*texts, *texts[:5], *texts[-3:]], 1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sizes, comps = brute_groups(rows)
    assert got == {i: (sizes[i], comps[i]) for i, _ in rows}


@pytest.mark.parametrize("frequent", [0.0, 0.4, 0.9, 1.0])
def test_ngram_entries_that_similar_sets_share(frequent):
    """At the very threshold, sets share a pair or as many single entries as they need, whatever is frequent."""
    draw = np.random.default_rng(int(10 * frequent))
    for n in (5, 9, 40, 101, 400, 1000):
        for _ in range(20):
            whole = np.unique(draw.integers(0, 1 << 48, 2 * n).astype(np.uint64))
            common = draw.permutation(whole)[:n]
            out = n // 5 if draw.integers(2) else n // 9  # a subset of 80 %, or as many in one set only as in the other
            a, b = (common, common[: n - out]) if out == n // 5 else (common, np.r_[common[: n - out], np.setdiff1d(whole, common)[:out]])
            often = whole[draw.random(len(whole)) < frequent]
            assert 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
            met = np.intersect1d(*(ngram_join._entries(np.sort(x), np.isin(np.sort(x), often)) for x in (a, b)))
            assert (met >= 1 << 63).any() or len(met) >= ngram_join._needed(min(ngram_join._size_class(len(a)), ngram_join._size_class(len(b))))


def test_ngram_oracle(spark):
    compare_with_sql(spark, SMALL, "documents", "op7_ngram_join")


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 8)
    draw = np.random.default_rng(5)
    centres = draw.standard_normal((6, 64))
    rows = []
    for k in range(160):
        c = centres[k % 6] if k % 3 else draw.standard_normal(64)
        rows.append((k, [float(x) for x in c * draw.uniform(0.1, 9) + draw.standard_normal(64) * draw.choice([0.0, 0.05, 0.2])], int(k % 2)))
    rows += [(200 + i, rows[1][1], rows[1][2]) for i in range(20)]
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0] * 64, [nan] + [1.0] * 63, [inf] + [1.0] * 63, [None] + [1.0] * 63]
    odd = [(300 + i, v, 0) for i, v in enumerate(bad)] + [(320, rows[1][1], None), (321, [1.0], 5), (322, [2.0], 5), (323, [-2.0], 5), (324, [1e-200, 1e-200], 5), (325, [1e200, 1e200], 5)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("bands", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    x = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    links = [(a, b) for k, (a, _, la) in enumerate(rows) for b, _, lb in rows[:k] if la == lb and x[a] @ x[b] >= 0.98]
    links += [(321, 322), (324, 325)]
    n, comp = Counter(i for p in links for i in p), groups([r[0] for r in rows + odd], links)
    assert len(links) > 300
    assert got == {i: (n[i], comp[i], comp[i] == i) for i, _, _ in rows + odd}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_that_share_an_id(spark):
    """Rows are judged by their own vectors, whatever their ids."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 0), (2, [1.0, 0.01, 0.0], 0), (1, b, 1), (3, [0.01, 1.0, 0.0], 1), (7, a, 0), (7, [0.0, 0.0, 1.0], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == sorted([(1, 2, 1), (2, 2, 1), (1, 1, 1), (3, 1, 1), (7, 2, 1), (7, 0, 7)])


@pytest.mark.parametrize("dimension", [16, 64, 200])
def test_estimates_are_unbiased_within_their_bounds(dimension):
    draw = np.random.default_rng(0)
    o, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in draw.standard_normal((2, 3000, dimension)))
    e = q - (q * o).sum(1, keepdims=True) * o
    q = 0.98 * o + math.sqrt(1 - 0.98**2) * e / np.linalg.norm(e, axis=1, keepdims=True)
    signs, factor, _, _ = embedding_dedup.codes(o)
    _, _, turned, unit = embedding_dedup.codes(q)
    estimate = (np.where(signs, 1, -1) * turned).sum(1) * unit / math.sqrt(dimension) / factor
    assert abs(estimate.mean() - 0.98) < 0.005
    least = embedding_dedup.least_estimate(factor, unit, dimension, 0.98)
    assert (estimate >= least).all() and least.mean() > (0.5 if dimension < 64 else 0.8)


@pytest.mark.parametrize(("dimension", "rows"), [(24, 6_000), (64, 20_000), (200, 6_000)])
def test_recall_of_planted_links(spark, dimension, rows):
    """All links of a planted set, with cosines from below the threshold to 1 and most of them just above it, by brute force."""
    draw = np.random.default_rng(dimension)
    x = draw.standard_normal((rows, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(rows // 2):  # each of the second half is turned from one of the first
        e = x[rows // 2 + k] - (x[rows // 2 + k] @ x[k]) * x[k]
        c = draw.choice([draw.uniform(0.98, 0.985), draw.uniform(0.98, 1), draw.uniform(0.95, 0.98)])
        x[rows // 2 + k] = c * x[k] + math.sqrt(1 - c * c) * e / np.linalg.norm(e)
    x = x.astype(np.float32)
    labels = draw.integers(0, 3, rows // 2).tolist() * 2
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(rows), "embedding": x.astype(float).tolist(), "label": labels}), "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.near_duplicates(df).toPandas().sort_values("vec_id").n_links.to_numpy()
    d = x.astype(float)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    want = np.zeros(rows, int)
    for label in range(3):
        at = np.flatnonzero(np.array(labels) == label)
        want[at] = (d[at] @ d[at].T >= 0.98).sum(1) - 1
    assert want.sum() > rows / 2 and (got == want).all()


def test_embeddings_oracle(spark, tmp_path):
    """The registered SQL, over rows with links; the small tables have none."""
    draw = np.random.default_rng(8)
    base = draw.standard_normal((40, 64))
    rows = [(i, [float(np.float32(v)) for v in base[i % 40] + draw.standard_normal(64) * 0.1 * (i % 3)], int(i % 40 % 2)) for i in range(160)] + [(500, None, 0), (501, [0.0] * 64, 0), (502, [1.0] * 64, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    compare_with_sql(spark, tmp_path, "embeddings", "op2_embedding_dedup", "/*.parquet")


def compare_with_sql(spark, sf_dir, table, name, files=""):
    con = duckdb.connect()
    con.execute(f"create view {table} as from '{sf_dir}/{table}.parquet{files}'")
    want = con.execute(queries.ORACLE_SQL[name])
    rows = queries.QUERIES[name](spark, str(sf_dir)).select([c[0] for c in want.description]).collect()
    assert rows and sorted(map(str, map(tuple, rows))) == sorted(map(str, want.fetchall()))


def test_url_lists_oracle(spark):
    got = queries.op5_url_lists(spark, SMALL)
    con = duckdb.connect()
    con.execute(f"create view pages as from '{SMALL}/pages.parquet'")
    want = con.execute(queries.OP5_SQL)
    rows = got.select([c[0] for c in want.description]).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want.fetchall()))


def test_url_lists_with_odd_rows(spark):
    captures = [(1, "http://A.Example.com/x?q#f", 5), (1, "http://A.Example.com/x?q#f", 5), (2, "https://u:p@a.example.com:8080/x?q", 40), (3, None, 5), (4, "", 5), (5, "nonsense", 5), (6, "http://deep.a.example.com", None), (7, "http://deep.a.example.com", 3000), (8, "http://other.org/", 5), (None, "http://a.example.com/", 9)]
    entries = [("a.example.com", 3, True), ("a.example.com", 9, False), ("a.example.com", 9, True), ("a.example.com", 30, False), ("=a.example.com/x?q", 4, True), (".example.com", 2000, True), (None, 1, True), ("other.org", None, True), ("other.org", 1, None), ("other.org", 6, True), ("other.org", 6, True)]
    df = spark.createDataFrame(captures, "page_id long, url string, fetch_day int").withColumn("pattern", F.lit("mine"))
    got = sorted(((r.page_id, r.fetch_day, r.n_listed, r.pattern, r.listed_since) for r in url_lists.evaluate(df, spark.createDataFrame(entries, "pattern string, day int, listed boolean")).collect()), key=str)
    want = [(1, 5, 2, "=a.example.com/x?q", 4)] * 2 + [(2, 40, 1, "=a.example.com/x?q", 4), (3, 5, 0, None, None), (4, 5, 0, None, None), (5, 5, 0, None, None), (6, None, 0, None, None), (7, 3000, 1, ".example.com", 2000), (8, 5, 0, None, None), (None, 9, 1, "a.example.com", 9)]
    assert got == sorted(want, key=str)
    none = spark.createDataFrame([], "pattern string, day int, listed boolean")
    assert url_lists.evaluate(df, none).where("blocked").count() == 0 and url_lists.evaluate(df.limit(0), none).count() == 0


def test_url_lists_with_large_day_numbers(spark):
    captures = spark.createDataFrame([(1, "http://a.org/", 20231231), (2, "http://a.org/", 20240105), (3, "http://a.org/", 20240115), (4, "http://b.org/", 2**31 - 1)], "page_id long, url string, fetch_day int")
    entries = spark.createDataFrame([("a.org", 20240101, True), ("a.org", 20240110, False), ("b.org", 2**31 - 20, True)], "pattern string, day int, listed boolean")
    got = {r.page_id: (r.n_listed, r.pattern, r.listed_since, r.blocked) for r in url_lists.evaluate(captures, entries).collect()}
    assert got == {1: (0, None, None, False), 2: (1, "a.org", 20240101, True), 3: (0, None, None, False), 4: (1, "b.org", 2**31 - 20, True)}


def test_scores(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [(10_000, None), (10_001, ""), (10_010, "word " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(3, "doc_id")
    got = {r.doc_id: r for r in pitman_yor.score(df).collect()}
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    counts = Counter(w for i, x in tokens.items() if not held[i] for w in x)
    n, v = sum(counts.values()), len(counts)
    assert set(got) == set(tokens)
    for i, x in tokens.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(x), sum(w in counts for w in x), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-11) and r.score < 0
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    again = {r.doc_id: r.score for r in pitman_yor.score(df).collect()}
    assert all(math.isclose(again[i], got[i].score, rel_tol=0.02) for i in got)


def test_scores_with_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (2, "b a")], "doc_id long, text string")
    got = pitman_yor.score(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"]
    none = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert [(r.train_tokens, r.n_known, r.score < 0 or r.score == 0) for r in pitman_yor.score(none).collect()] == [(0, 0, True)]
    assert pitman_yor.score(df.limit(0)).count() == 0


def test_predictions_sum_to_one(spark, monkeypatch):
    """Over the vocabulary and the unknown word, after one context."""
    monkeypatch.setattr(pitman_yor, "remainder", lambda doc_id, m: F.when(doc_id >= 100, 0).otherwise(1))
    train = [(i, f"x {w}") for i, w in enumerate("a b c a a d x e f g a b".split())]
    asked = [(100 + i, f"x {w}") for i, w in enumerate([*"abcdefgx", "new"])]
    frame = lambda rows: {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(train + rows, "doc_id long, text string")).collect()}
    got = frame([*asked, (200, "x"), *((300 + i, w) for i, w in enumerate([*"abcdefgx", "new"]))])
    assert all(math.isfinite(s) for s in got.values())
    # p(w | x) = p(x w end) / (p(x | start) p(end | w)); p(x | start) from "x" alone and p(end | x), and so on: the first words' sum to one with the end
    first = sum(10 ** (got[300 + i]) for i in range(9))
    assert 0 < first <= 1.0


@pytest.mark.parametrize(("customers", "times"), [(3, 20_000), (40, 4_000), (10_000, 150)])
def test_seating_is_that_of_single_customers(customers, times):
    """Numbers of tables against customers who sit down one by one, at every size."""
    discount, strength, prior, other = 0.8, 2.0, 0.03, 50
    draw = np.random.default_rng(4)
    args = [np.full(times, x) for x in (customers, prior, other)]
    got = pitman_yor.seat(args[0], args[1], args[2], discount, strength, pitman_yor._keys(np.arange(times)))
    want = np.ones(times)
    for s in range(1, customers):
        new = (strength + discount * (other + want)) * prior
        want += draw.random(times) < new / (new + s - discount * want)
    error = math.sqrt((got.var() + want.var()) / times)
    assert abs(got.mean() - want.mean()) < 5 * error
    assert 0.7 < (got.std() + 1e-9) / (want.std() + 1e-9) < 1.4
    assert got.min() >= 1 and got.max() <= customers


def test_seating_is_the_same_dish_by_dish(monkeypatch):
    """Long dishes sit down customer by customer in arrays of their own, with the same result."""
    draw = np.random.default_rng(2)
    customers = draw.integers(0, 900, 300)
    args = (customers, draw.random(300) / 10, draw.integers(0, 400, 300), 0.8, 2.0, pitman_yor._keys(np.arange(300), 7))
    want = pitman_yor.seat(*args)
    for name, value in {"LONG": 10, "FEW": 1000, "BLOCK": 50}.items():
        monkeypatch.setattr(pitman_yor, name, value)
    assert (pitman_yor.seat(*args) == want).all() and (want[customers == 0] == 0).all()
    backward = [x[::-1] if isinstance(x, np.ndarray) else x for x in args]
    assert (pitman_yor.seat(*backward)[::-1] == want).all()


def test_scores_do_not_depend_on_groups_or_partitions(spark, monkeypatch):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: r.score for r in pitman_yor.score(documents).collect()}
    monkeypatch.setattr(pitman_yor, "partitions", lambda spark: 11)
    monkeypatch.setattr(pitman_yor, "BATCH_WORDS", 3000)
    monkeypatch.setattr(pitman_yor, "HOT", 0.05)
    got = {r.doc_id: r.score for r in pitman_yor.score(documents.repartition(5)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_hot_words_of_long_and_short_documents(spark):
    """Batches of long documents count too, though ends are rare in them: a third of all tokens is found, and what is frequent in the short documents alone is not."""
    long = [(i, " ".join(w for k in range(100) for w in ("the", f"a{i}x{k}", f"b{i}x{k}"))) for i in range(60)]
    short = [(100 + i, f"rare c{i}") for i in range(100)]
    of = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).select(F.col("doc_id").alias("row"), "doc_id", "text", F.lit(True).alias("train"))
    hashed = lambda w: int(pitman_yor.xxhash.xxh64_intdigest(w)) & int(pitman_yor.MASK)
    want = {int(pitman_yor.END), hashed(b"the")}
    assert {int(w) for w in pitman_yor._hot_words(of(long), 4)} == want
    assert {int(w) for w in pitman_yor._hot_words(of(long).union(of(short)), 4)} == want


def test_word_totals_beyond_32_bits():
    words = pitman_yor._planes(np.array([5, 2], np.uint64), 7)
    none = pitman_yor._ints(np.zeros(0))
    asked = [(g, 0, words, pitman_yor._ints(np.array([3_000_000_000, 7])), pitman_yor._ints(np.array([1, 1])), none, none, none) for g in (0, 1)]
    got = pitman_yor.count_slice(pitman_yor._table(pitman_yor.FIRST, asked)).to_pylist()
    assert [(r["tokens"], r["types"], pitman_yor._from_ints(r["customers"]).tolist()) for r in got] == [(6_000_000_014, 2, [6_000_000_000, 14])] * 2


def test_hot_and_ordinary_contexts_sum_to_one(spark, monkeypatch):
    """With several groups. Scores of one and two words give p(end | x) if each word's probabilities sum to one; then those after the start (always hot) must too."""
    monkeypatch.setattr(pitman_yor, "remainder", lambda doc_id, m: F.when(doc_id >= 10_000, 0).otherwise(1))
    draw = np.random.default_rng(3)
    words = [f"w{i}" for i in range(24)]
    train = [(i, " ".join(words[k] for k in np.minimum(23, draw.geometric(0.15, draw.integers(1, 4)) - 1))) for i in range(2000)]
    words = [*sorted({w for _, t in train for w in t.split()}), "new"]
    asked = ["", *words, *(f"{x} {y}" for x in words for y in words)]
    rows = train + [(10_000 + i, t) for i, t in enumerate(asked)]
    got = {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("doc_id >= 10000").collect()}
    chance = {t: 10 ** got[10_000 + i] for i, t in enumerate(asked)}
    k = len(words)
    # u = 1 / p(end | x): u[x] = 1 + sum over y of chance[x y] / chance[x] * u[y]
    u = np.linalg.solve(np.eye(k) - [[chance[f"{x} {y}"] / chance[x] for y in words] for x in words], np.ones(k))
    assert (u > 1).all()
    assert abs(chance[""] + sum(chance[x] * u[i] for i, x in enumerate(words)) - 1) < 1e-4


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = {}
    state = docs
    for name, stage in corpus_pipeline.STAGES:
        before, state = state, spark.createDataFrame(stage(spark, state, SMALL).toPandas())
        sizes[name] = state.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert state.columns == docs.columns
        if name == "quality classifier":
            kept = {r.doc_id for r in queries.op10_quality(spark, SMALL).where("predicted = 1").select("doc_id").collect()}
            assert {r.doc_id for r in state.collect()} == kept
        if name == "line dedup":
            lines = [(r.text or "").split("\n") for r in before.collect()]
            strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
            held = Counter(k for doc in lines for k in {strip(x) for x in doc} if k)
            want = ["\n".join(x for x in doc if not strip(x) or held[strip(x)] < 10) for doc in lines]
            assert sorted((r.text, r.n_chars) for r in state.collect()) == sorted((t, len(t)) for t in want)
        if name == "SentencePiece encoding":
            model = unigram.load()
            of = lambda t: [i for x in unigram.STRETCH.findall(unigram.escaped(t)) for i in model._encode_any(x)]
            assert all(list(r.ids) == of(r.text) for r in state.sample(0.2, seed=1).toPandas().itertuples())
        if name == "n-gram Jaccard join":
            _, comps = brute_groups([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in state.collect()} == {i for i, c in comps.items() if i == c}
    assert 0 < sizes["quality classifier"] <= docs.count()
    assert sizes["SentencePiece encoding"] == sizes["mixing sources to target weights"]
    assert state.columns == [*docs.columns, "ids"]
    rows = [(1, "x y z a b c d e f g"), (1, "x y z a b c d e f g"), (1, "another text that is not like it at all"), (2, "x y z a b c d e f g"), (None, "x y z a b c d e f g"), (None, "one more text of its own, without an id")]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    left = corpus_pipeline.near_duplicate_stage(spark, odd, SMALL)
    assert left.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, [rows[0], rows[2], rows[5]]))
    assert corpus_pipeline.run(spark, SMALL).count() == sizes["SentencePiece encoding"]


@pytest.mark.parametrize("slices", [1, 3, 70_000])
def test_slices_answer_what_entries_tell(slices):
    """Links connect the nodes that a plain program connects, and what four nodes hold is frequent, within a block or over several."""
    rng = np.random.default_rng(slices)
    node, n = np.cumsum(rng.integers(1, 1 << 40, 90)), rng.integers(3, 9, 90)
    pool = np.r_[rng.integers(0, 1 << 48, 150), rng.integers(0, 1 << 62, 40) | -(1 << 63)].astype(np.int64).view(np.uint64)
    made = [np.unique(pool[np.r_[np.minimum(189, rng.geometric(0.03, 2)), rng.integers(0, 190, 2)]]) for _ in node]
    blocks = [ngram_join._told(node[a:b], n[a:b], made[a:b], slices) for a, b in ((0, 40), (40, 41), (41, 41), (41, 90))]
    told = pa.Table.from_batches(blocks)
    rows = [r for q in set(told["q"].to_pylist()) for r in ngram_join._answered(told.filter(pa.array([x == q for x in told["q"].to_pylist()])), slices).to_pylist()]
    held = Counter(e for x in made for e in x.tolist())
    hot = {e for e, c in held.items() if e < 1 << 63 and c >= 4}
    assert sorted(r["a"] for r in rows if r["kind"] == 1) == sorted(hot) and hot
    assert {r["a"] for r in rows if r["kind"] == 2} == {i for i, x in zip(node.tolist(), made) if hot & set(x.tolist())}

    def parts(links):
        of = {i: {i} for i in node.tolist()}
        for a, b in links:
            whole = of[a] | of[b]
            of.update(dict.fromkeys(whole, whole))
        return {frozenset(x) for x in of.values()}

    at = {}
    for i, k, x in zip(node.tolist(), n.tolist(), made):
        for e in set(x.tolist()) - hot:
            for z in (0, 1):
                at.setdefault((e, ngram_join._size_class(k) + z), []).append(i)
    want = parts((x[0], y) for x in at.values() for y in x)
    assert parts((r["a"], r["b"]) for r in rows if r["kind"] == 0) == want and 1 < len(want) < 90
