"""Language-model scores against a plain sequential program that draws the same hashed random numbers."""

import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import pitman_yor as model


def sat(customers, prior, other, discount, strength, key):
    """Tables of one dish, customer by customer."""
    tables = 1 if customers else 0
    for s in range(1, customers):
        odds = float(model._odds(np.array([key], np.uint64), s)[0])
        new = (strength + discount * (other + tables)) * prior
        tables += new * odds > s - discount * tables
    return tables


def key_of(*parts):
    return model._keys(*(np.array([p], np.uint64) for p in parts))[0]


def plain_scores(rows, held_out):
    """log10 probabilities of the texts of rows (id, text)."""
    word = lambda w: int(model.xxhash.xxh64_intdigest(w)) & int(model.MASK)
    end = int(model.END)
    texts = {i: [*(word(w) for w in (t or "").lower().encode().split()), end] for i, t in rows}
    pairs = Counter(p for i, x in texts.items() if not held_out(i) for p in zip([end, *x], x))
    counts = Counter()
    for (_, w), k in pairs.items():
        counts[w] += k
    n, v = sum(counts.values()), len(counts)
    of_context = Counter()
    for (c, _), k in pairs.items():
        of_context[c] += k
    tables = dict.fromkeys(pairs, 1)
    own, grand = dict.fromkeys(counts, 1), v
    prior = {w: (k + 1) / (n + v + 1) for w, k in counts.items()}
    samples, summed = [], Counter()
    for turn in range(model.BURN + model.SAMPLES):
        total = Counter()
        for (c, _), t in tables.items():
            total[c] += t
        tables = {(c, w): sat(k, prior[w], total[c] - tables[c, w], model.DISCOUNT, model.STRENGTH, key_of(c, w, turn)) for (c, w), k in pairs.items()}
        customers = Counter()
        for (_, w), t in tables.items():
            customers[w] += t
        own = {w: sat(k, 1 / (v + 1), grand - own[w], model.PARENT_DISCOUNT, model.PARENT_STRENGTH, key_of(w, turn, 1)) for w, k in customers.items()}
        parents, grand = sum(customers.values()), sum(own.values())
        unseen = (model.PARENT_STRENGTH + model.PARENT_DISCOUNT * grand) / (v + 1)
        prior = {w: (k - model.PARENT_DISCOUNT * own[w] + unseen) / (model.PARENT_STRENGTH + parents) for w, k in customers.items()}
        if turn >= model.BURN:
            total = Counter()
            for (c, w), t in tables.items():
                total[c] += t
                summed[c, w] += t
            samples.append((total, prior, unseen / (model.PARENT_STRENGTH + parents)))

    def chance(c, w):
        of_pair = pairs[c, w] - model.DISCOUNT * summed[c, w] / model.SAMPLES if (c, w) in pairs else 0.0
        back = sum((model.STRENGTH + model.DISCOUNT * total[c]) * prior.get(w, new) for total, prior, new in samples) / model.SAMPLES
        return (of_pair + back) / (model.STRENGTH + of_context[c])

    return {i: sum(math.log10(chance(c, w)) for c, w in zip([end, *x], x)) for i, x in texts.items()}


def corpus(kind):
    draw = np.random.default_rng(8)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(words[k] for k in np.minimum(59, draw.geometric(0.08, draw.integers(0, 25)) - 1))) for i in range(90)]
    if kind == "hot pair":  # a third of all tokens and more are one pair, in every document and in one
        rows = [(i, t + " hot pair" * 6) for i, t in rows] + [(100, "hot pair " * 300), (101, "hot hot hot hot")]
    return rows


@pytest.mark.parametrize("kind", ["ordinary", "hot pair"])
@pytest.mark.parametrize(("groups", "hot", "codes"), [(4, 0.25, 1 << 18), (9, 0.3, 20), (5, 0.02, 0)])
def test_scores_are_those_of_a_sequential_program(spark, monkeypatch, kind, groups, hot, codes):
    monkeypatch.setattr(model, "partitions", lambda spark: groups)
    monkeypatch.setattr(model, "HOT", hot)
    monkeypatch.setattr(model, "CODES", codes)
    monkeypatch.setattr(model, "SLICES", 3)
    monkeypatch.setattr(model, "remainder", lambda doc_id, m: F.when(doc_id % 10 == 3, 0).otherwise(1))
    rows = corpus(kind)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    shared = model._frequent(df.select(F.col("doc_id").alias("row"), "doc_id", "text", F.lit(True).alias("train")), groups)
    if kind == "hot pair":
        assert len(shared.keys) and shared.parts.max() > 1
    got = {r.doc_id: r.score for r in model.score(df).collect()}
    want = plain_scores(rows, lambda i: i % 10 == 3)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_a_hot_pair_is_dealt_over_many_groups(spark):
    """A third of all tokens in one pair: no group gets more than four times the tokens of the median one."""
    groups = 12
    draw = np.random.default_rng(1)
    rows = [(i, " ".join(["the same"] * 60 + [f"a{x}" for x in draw.integers(0, 5000, 120)])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("doc_id").alias("row"), "doc_id", "text", F.lit(True).alias("train")).repartition(24)
    shared = model._frequent(df, groups)
    held = defaultdict(int)
    tokens, _ = model._tokens([t.encode() for _, t in rows])
    context = np.concatenate([[model.END], tokens[:-1]])
    pair = shared.pair_at(context, tokens)
    assert (pair >= 0).mean() > 0.3
    # batches are the 24 parts here; a pair's part of a batch goes to one group
    for i in range(24):
        mine = slice(i * len(tokens) // 24, (i + 1) * len(tokens) // 24)
        for g, n in zip(*np.unique(model.dealt(context[mine], tokens[mine], i << 33, shared, groups), return_counts=True), strict=True):
            held[g] += n
    assert max(held.values()) <= 4 * np.median(list(held.values()))


@pytest.mark.parametrize("coded", [[], [7, 3, 900]])
def test_rounds_get_back_a_group_s_pairs(coded):
    u = lambda *x: np.array(x, np.uint64)
    shared = model.Shared(u(3), np.array(coded, np.uint64), u(3, 7).reshape(1, 2), np.array([2]))
    words, asked = u(2, 3, 7, 1 << 55), np.array([1, 2])
    for pairs, customers in (([1 << 32 | 1, 1 << 32 | 2, 3 << 32 | 1], [2, 0, 70_000]), ([], [])):
        one = model.Pairs(words, asked, np.array(pairs, np.int64), np.array(customers, np.int64), shared)
        two = model.Pairs.unpacked(one.packed(shared), shared)
        for name in ("words", "asked", "pairs", "customers", "pair_context", "pair_word", "is_hot", "hot_pair", "mine"):
            a, b = getattr(one, name), getattr(two, name)
            assert a.dtype == b.dtype and a.tolist() == b.tolist()


def test_a_group_s_memory_does_not_grow_with_batches_or_their_documents():
    """A group meets every batch of the corpus: 200 batches of 100 tokens each, in 10,000 documents each, with 100,000 words written as numbers, take no table of these for each batch."""
    draw = np.random.default_rng(6)
    shared = model.Shared(np.array([model.END]), np.unique(draw.integers(0, 1 << 56, 100_000)).astype(np.uint64), np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
    f, rows, trained = len(shared.coded), [], 0
    for batch in range(200):
        others = np.unique(draw.integers(0, 1 << 56, 5)).astype(np.uint64)
        context, token = np.sort(draw.integers(0, 50, 100)), draw.integers(0, f + 5, 100)
        docs, flags = draw.integers(0, 10_000, 100), np.arange(10_000) < 9_000
        trained += int(flags[docs].sum())
        rows.append((0, batch, model._planes(np.diff(others, prepend=np.uint64(0)), 7), model._ints(np.diff(context, prepend=0)), model._ints(token), model._ints(docs), model._ints(np.ones(100)), 9_000, model._squeeze(flags.tobytes())))
    part = model._table("g long, batch long, words binary, contexts binary, tokens binary, docs binary, times binary, trained long, train binary", rows)
    model.Group(part, shared)
    tracemalloc.start()
    try:
        group = model.Group(part, shared)
        _, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert most < 20e6
    assert len(group.pair) == 20_000 and group.customers.sum() == trained
