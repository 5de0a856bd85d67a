"""Source audit, best-fit packing and phrase collocations against SQL, brute force and odd rows."""

import bisect
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import best_fit, collocations, queries, source_audit

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def by_sql(name, tables=("documents",), sf=SMALL):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as from '{sf}/{t}.parquet'")
    return con.execute(queries.ORACLE_SQL[name]).df()


def as_set(frame, columns):
    return sorted(frame[list(columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ["op11_source_audit", "op13_collocations"])
def test_against_sql(spark, name):
    want = by_sql(name)
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert as_set(got, want.columns) == as_set(want, want.columns)


# source audit


def plain_audit(rows, min_docs, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for la, _, terms in docs if la == lang for t in set(terms))
        kept = [t for t, n in held.items() if n >= min_docs]
        groups = defaultdict(Counter)
        for la, source, terms in docs:
            if la == lang:
                groups[source].update(t for t in terms if held[t] >= min_docs)
        whole = sum(groups.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        shares, q = {g: share(c) for g, c in groups.items()}, share(whole)
        for g, p in shares.items():
            pairs = sorted((-sum((p[t] - x[t]) ** 2 // x[t] for t in kept), h.encode()) for h, x in shares.items() if h != g)
            terms = sorted((-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if groups[g][t] and p[t] > q[t])[:top]
            out += [(lang, g, part, item.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found)]
    return sorted(out)


ROWS = [
    ("Alpha beta beta; ÄÖ ÄÖ gamma", "en", "a"), ("alpha BETA x1y", "en", "b"), ("alpha beta\0gamma", "en", None), (None, "en", "empty"), ("", None, None), ("ÄÖ beta ÄÖ", "en", "b"), ("ÄÖ", "en", "b"),
    *[("hot hot hot alpha", "en", "hot")] * 40, ("one two", "de", "a"), ("drei", "de", "ß"), (" zeta  zeta", "fr", "a"), (" zeta", "fr", "a"), (" zeta", "fr", "a"), ("x" * 300_000 + " beta alpha", "en", "long"), ("word " * 100_000 + "beta", "en", "long"),
]
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


@pytest.mark.parametrize("tile", [64, 2])
def test_audit_of_odd_rows(spark, monkeypatch, tile):
    monkeypatch.setattr(source_audit, "TILE", tile)
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "text string, lang string, source string, term string").withColumns({c: F.lit(1) for c in ("n", "docs", "_rank")}).repartition(3)
    got = source_audit.audit(df, top=2).toPandas()
    assert as_set(got, COLUMNS) == plain_audit(ROWS, 3, 2)


@pytest.mark.parametrize("chunk", [1, 64, 2 << 20])
def test_chunks_count_each_text_once(monkeypatch, chunk):
    monkeypatch.setattr(source_audit, "CHUNK_BYTES", chunk)
    texts = [(len(lang or ""), memoryview((text or "").encode())) for text, lang, _ in ROWS]
    n, docs, want_n, want_docs = Counter(), Counter(), Counter(), Counter()
    monkeypatch.setattr(source_audit, "MERGED_BYTES", 5 * chunk)
    for found, *columns in source_audit.counted(texts):
        for group, term, k, d in zip(*(x.tolist() for x in columns), strict=True):
            n[group, found[term]] += k
            docs[group, found[term]] += d
    for group, text in texts:
        terms = re.findall(rb"[a-z\x80-\xff]+", bytes(text).lower())
        want_n.update((group, t) for t in terms)
        want_docs.update((group, t) for t in set(terms))
    assert (n, docs) == (want_n, want_docs)


def test_audit_of_an_empty_table(spark):
    assert source_audit.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_slices_of_equal_hashes_are_told_apart_by_their_bytes():
    words = [b"ab", b"cd", b"ab", b"abc", b"cd", b"x", b"abc", b"ab"]
    buffer = source_audit.LOWER[np.frombuffer(b" ".join(words), np.uint8)]
    starts, ends = source_audit.slices(buffer)
    for hashed in (lambda x: 1, lambda x: len(x), hash):
        number, first = source_audit.grouped(buffer, starts, ends, lambda x, f=hashed: f(x) & 0xFFFF)
        assert len(set(number)) == len(first) == 4
        assert len({(n, w) for n, w in zip(number.tolist(), words, strict=True)}) == 4
        assert [words[i] for i in first[number]] == words


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 1), (0, 7), (6, 7), (10**12, 3 * 10**12 + 1), (10**15 - 1, 10**15), (4 * 10**15, 9 * 10**15)]
    want = [1 + 10**9 * (c + 1) // t for c, t in cases]
    assert source_audit.shares(*np.array(cases).T).tolist() == want
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, c long, t long")
    assert [r.p for r in df.select("i", source_audit.share(F.col("c"), F.col("t")).alias("p")).orderBy("i").collect()] == want


# packing


def plain_best_fit(lengths, capacity):
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        n += i == len(gaps)
        gap = capacity if i == len(gaps) else gaps.pop(i)
        if gap > x:
            bisect.insort(gaps, gap - x)
    return n


def check_packing(rows, packed, capacity, encode):
    """Every document's pieces are right, sequences have no gaps and no overlap, and there are as few of them as best fit makes."""
    want = []
    for doc_id, text in rows:
        ids = np.array([*encode(text or ""), 0], "<u4")
        want += [(doc_id, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=lambda r: key((r[0] or 0, *r[1:]))) == sorted(want, key=lambda r: key((r[0] or 0, *r[1:])))
    held = defaultdict(list)
    for r in packed:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        spans.sort()
        assert [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()]
        assert sum(n for _, n in spans) <= capacity
    assert len(held) == plain_best_fit([r[3] for r in want], capacity)


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    of = Tokenizer.from_file(PATH)
    return lambda text: of.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [2048, 8, 1])
def test_packing_of_odd_rows(spark, encode, capacity):
    texts = [None, "", " \t\n", "It's   a TEST: don't!", "Straße ÉTÉ été   　x", "日本語のテキスト 12345", "a<|endoftext|>b <|startoftext|>", "\x00 \x1c y\x1cz \x85", "word " * 7000, "x" * 5000, *["same text here"] * 30, "ǅ ΣΑΣ Σ", "́ ́x á"]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("y") for c in ("length", "batch", "sequence_id", "_rank")}).repartition(3)
    check_packing(rows, best_fit.pack(df, PATH, capacity).collect(), capacity, encode)


def test_packing_of_documents(spark, encode):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    check_packing([tuple(r) for r in df.collect()], queries.op12_best_fit(spark, SMALL).collect(), 2048, encode)


def test_sequences_hold_the_ids(spark, encode):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = best_fit.sequences(best_fit.pack(df, PATH, 64, ids=True)).collect()
    assert all(len(r.ids) == r.n_tokens <= 64 for r in held)
    found = Counter(tuple(x) for r in held for x in np.split(np.array(r.ids), np.flatnonzero(np.array(r.ids) == 0) + 1) if len(x))
    assert found == Counter(tuple(y) for _, t in rows for ids in [[*encode(t), 0]] for y in [ids[k : k + 64] for k in range(0, len(ids), 64)])


def test_packing_of_an_empty_table(spark):
    assert best_fit.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_sweep_is_best_fit_in_descending_order():
    rng = np.random.default_rng(3)
    for turn in range(120):
        capacity = int(rng.integers(1, 60))
        lengths = np.concatenate([rng.integers(1, capacity + 1, int(rng.integers(0, 300))), np.ones(200 * (turn % 3 == 0), int)])
        flows = best_fit.sweep(*np.unique(lengths, return_counts=True), capacity)
        used = {s + k // per for _, _, n, s, per, _ in flows for k in range(n)}
        assert len(used) == plain_best_fit(lengths.tolist(), capacity)
        assert sum(n for _, _, n, *_ in flows) == len(lengths)


def test_many_short_pieces_make_few_flows():
    """A third of a billion pieces of one length, and all other lengths."""
    flows = best_fit.sweep(np.arange(1, 2049), np.r_[333_333_333, np.full(2047, 12_345)])
    assert len(flows) < 20_000
    tokens = 333_333_333 + 12_345 * sum(range(2, 2049))
    assert max(s + -(-n // per) for _, _, n, s, per, _ in flows) == -(-tokens // 2048)


def test_words_beyond_the_cache(monkeypatch, encode):
    monkeypatch.setattr(best_fit, "CACHED_WORDS", 50)
    monkeypatch.setattr(best_fit, "_known", [])
    texts = [" ".join(f"w{i * j}x" for j in range(30)) for i in range(40)]
    got = list(best_fit.word_ids(PATH).of([t.encode() for t in texts]))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [encode(t) for t in texts]


# phrases


def plain_phrases(rows, least, longest, covered, top):
    out, rows = [], [("und" if la is None else la, text) for la, text in rows]
    for lang in {la for la, _ in rows}:
        f = Counter()
        for la, text in rows:
            if la == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
                    words = re.findall(r"[^\x20\x09]+", piece)
                    f.update(tuple(words[i : i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
        n = sum(v for k, v in f.items() if len(k) == 1)
        cases = {k: v for k, v in f.items() if len(k) > 1 and v >= least}
        found = []
        for p, a in cases.items():
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cases.items()):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n, -s) for i, (s, a, p, le, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


PHRASES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
TEXTS = [
    ("en", "New York City, new york; the the the the the\nof the\x0bof the. in  New\tYork"), ("en", None), (None, "a b a b a b a b."), ("", "a b"), ("en", ""), ("en", ".,;\n"), ("en", "Ä b ä b \x1c x \x00 y"),
    *[("en", "the common phrase of all")] * 30, ("en", "the " * 30_000), ("de", "eins zwei drei vier fünf sechs " * 9),
]


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_phrases_of_odd_rows(spark, longest):
    df = spark.createDataFrame([(*r, "x") for r in TEXTS], "lang string, text string, phrase string").withColumn("n", F.lit(0)).repartition(2)
    got = collocations.collocations(df, 3, longest, 50, 20).toPandas()
    assert as_set(got, PHRASES) == plain_phrases(TEXTS, 3, longest, 50, 20)


@pytest.mark.parametrize(("shard", "slice_", "held"), [(6 << 20, 50_000, 24 << 20), (40, 7, 24 << 20), (500, 3, 100), (1, 1, 1)])
@pytest.mark.parametrize(("longest", "whole"), [(1, False), (2, False), (3, False), (3, True), (4, True)])
def test_stretches_and_slices_count_every_occurrence_once(monkeypatch, longest, whole, shard, slice_, held):
    for name, value in (("SHARD_BYTES", shard), ("SLICE", slice_), ("HELD_BYTES", held)):
        monkeypatch.setattr(collocations, name, value)
    rows = [("en" if la is None else la, (text or "")[:3000]) for la, text in TEXTS]
    all_ = [collocations.Filter(np.full(8, 255, np.uint8))] * longest
    lengths = range(2, longest + 1) if whole else [longest]
    got, want = Counter(), Counter()
    batches = [pa.RecordBatch.from_pydict({"lang": [r[0] for r in part], "text": pa.array([r[1] for r in part], pa.string())}) for part in (rows[:9], rows[9:])]
    for lang, ids, words, done in collocations.shards(iter(batches), longest - 1):
        if longest == 1:
            got.update({(lang, w): int((ids == i).sum()) for i, w in enumerate(words) if (ids == i).any()})
        else:
            for places, n in collocations.mined(ids, collocations.word_hashes(lang, words), longest, all_, whole, done) if words else []:
                for *at, k in zip(*places, n.tolist(), strict=True):
                    got[lang, b" ".join(words[i] for i in at)] += k
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate({c: c + 32 for c in range(65, 91)})):
            words = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang, " ".join(words[i : i + m]).encode()) for m in lengths for i in range(len(words) - m + 1))
    assert got == want


def test_a_full_filter_only_costs_time(spark, monkeypatch):
    """Where all bits are set nothing is left out, and counts below the least still go."""
    monkeypatch.setattr(collocations, "phrase_filter", lambda phrases: collocations.Filter(np.full(1024, 255, np.uint8)))
    df = spark.createDataFrame(TEXTS, "lang string, text string")
    assert as_set(collocations.collocations(df, 3).toPandas(), PHRASES) == plain_phrases(TEXTS, 3, 3, 50, 2000)


def test_phrases_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_the_best_are_those_of_highest_score_whatever_their_occurrences(spark):
    """Scores 981 to 1020 share a step, and those with few occurrences are the best; then equal scores, told apart by occurrences and phrases."""
    rows = [("en", f"x y{i}", 1000 - 20 * i, 981 + i) for i in range(40)] + [("de", f"x y{i:02}", 10 + i // 4, 5) for i in range(40)]
    best = collocations.best_of(spark.createDataFrame(rows, "lang string, phrase string, a long, score long"), 5).collect()
    for lang in ("en", "de"):
        order = lambda r: (-r[3], -r[2], r[1])
        assert sorted((tuple(r) for r in best if r.lang == lang), key=order)[:5] == sorted((r for r in rows if r[0] == lang), key=order)[:5]
    assert len(best) < 20


def test_phrases_of_many_close_scores(spark):
    rng = np.random.default_rng(5)
    rows = [("en", " ".join(f"w{int(x)}" for x in 40 * rng.random(200) ** 2)) for _ in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string")
    for top in (20, 150):
        assert as_set(collocations.collocations(df, 3, 2, 50, top).toPandas(), PHRASES) == plain_phrases(rows, 3, 2, 50, top)


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = {"x": 4 * 10**12, "y": 5 * 10**12, "x y": 3 * 10**12, "y x": 10**12}
    singles = spark.createDataFrame([("en", p, i, n) for i, (p, n) in enumerate(big.items()) if " " not in p] + [("en", None, 0, 10**13)], "lang string, phrase string, h long, n long")
    pairs = spark.createDataFrame([("en", p, 2, n) for p, n in big.items() if " " in p], "lang string, phrase string, words int, n long")
    monkeypatch.setattr(collocations, "word_counts", lambda rows, least: singles)
    monkeypatch.setattr(collocations, "phrase_counts", lambda rows, longest, filters, least: pairs)
    got = collocations.collocations(spark.createDataFrame([], "lang string, text string"), longest=2).collect()
    assert {r.phrase: r.score for r in got} == {p: 10**6 * a * a // (big["x"] * big["y"]) for p, a in big.items() if " " in p}
