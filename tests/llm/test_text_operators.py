"""Fingerprints, token counts and SentencePiece encoding against brute force and the library's own encoder."""

import hashlib
import re
import struct

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidewater.llm import fingerprints, queries, sentencepieces, token_counts, unigram

SMALL = "/root/testdata/sf0.001"
ODD = ["", None, " ", "a", "  two  spaces ", "\n\n", "tab\tand\nline", "𝔘ñ 門 ​", "x" * 3000, "word " * 3000, "é" * 200 + "\n" + "!" * 70]


@pytest.fixture(scope="module")
def model():
    return unigram.load()


def varint(n):
    out = b""
    while True:
        b, n = n & 127, n >> 7
        out += bytes([b | (128 if n else 0)])
        if not n:
            return out


@pytest.fixture(scope="module")
def library(model):
    """The library's unigram encoder over the same pieces and weights."""
    source, weights, out = sentencepiece.SentencePieceProcessor(model_file=unigram.MODEL), dict(zip(model.ids, model.weights, strict=True)), b""
    for i in range(model.size):
        piece = source.id_to_piece(i).encode()
        kind = 2 if source.is_unknown(i) else 3 if source.is_control(i) else 6 if source.is_byte(i) else 1
        inner = b"\x0a" + varint(len(piece)) + piece + b"\x15" + struct.pack("<f", weights.get(i, 0) * unigram.UNIT) + b"\x18" + varint(kind)
        out += b"\x0a" + varint(len(inner)) + inner
    trainer, normal = b"\x18\x01" + varint(35 << 3) + b"\x01", b"\x0a\x08identity\x18\x01\x20\x00\x28\x01"
    out += b"\x12" + varint(len(trainer)) + trainer + b"\x1a" + varint(len(normal)) + normal
    made = sentencepiece.SentencePieceProcessor()
    made.LoadFromSerializedProto(out)
    return made


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()] + ODD


def test_counts_equal_the_library(spark, library, texts):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in token_counts.count_tokens(df).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == [len(library.encode(t or "")) for t in texts]
    assert token_counts.count_tokens(df.limit(0)).count() == 0 and got[0].ids == "z"


@pytest.mark.parametrize(("giant", "chunk", "fan"), [(65_536, 8_192, 64), (50, 16, 4), (0, 33, 3)])
def test_ids_equal_the_library_in_chunks_or_whole(spark, monkeypatch, library, texts, giant, chunk, fan):
    monkeypatch.setattr(sentencepieces, "FAN", fan)
    some = texts if giant > 1000 else texts[::8] + ODD + ["same"] * 2
    df = spark.createDataFrame([(i, t, i % 3, "a", "b") for i, t in enumerate(some)], "doc_id long, text string, _row long, row string, made string")
    encoded = sentencepieces.encode(df, giant=giant, chunk=chunk)
    assert encoded.columns == [*df.columns, "ids"]
    decode = sentencepieces.decoder(spark)
    got = {r.doc_id: r for r in encoded.withColumn("back", decode(F.col("ids"))).collect()}
    assert len(got) == len(some)
    for i, t in enumerate(some):
        assert got[i].ids == library.encode(t or "") and got[i].back == (t or "")


def test_counts_of_unknown_characters_and_long_stretches(spark, library, model):
    odd = ["門門𝔘a" * 5 + "ñ", "x" * 20_000, "ab" * 9_000 + "門" * 300, "\u2003" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()}
    assert got == {i: len(library.encode(t)) for i, t in enumerate(odd)}
    kept = unigram.Kept(model.count, 10)
    assert kept["y" * 5000] and kept["▁a"] and list(kept) == ["▁a"]


def test_encoding_of_an_empty_table(spark):
    assert sentencepieces.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_transfer_is_the_best_of_all_paths(model):
    """Against a pass for each state before the chunk, with and without a certain cut in it."""
    draw, most = np.random.default_rng(0), model.longest
    for text in ["▁the▁quick▁brown▁fox", "▁" * 40, "abcdefghij" * 4, "line\n\nline▁ß門▁x", *("".join(draw.choice(list("ab▁\né"), 60)) for _ in range(6))]:
        for before in (0, 1, 7):
            n, found = len(text) - before, sentencepieces.transfer(model, text, before)
            for state in range(min(most, before + 1)):
                best = {-state: 0}
                for end, pieces in enumerate(model.matches(text)):
                    at = end - before
                    sums = [best[at - length] + w for length, w, _ in pieces if at - length in best] if at > 0 else []
                    if sums:
                        best[at] = max(sums)
                # what lies before a certain cut in the chunk leads nowhere
                cut = sentencepieces._CERTAIN.search(text, max(before, 1))
                first = cut.start() - before if cut else -most
                want = [best.get(n - t, unigram.NONE) if n - t >= first and (n - t > 0 or n - t == -state) else unigram.NONE for t in range(most)]
                assert found[state].tolist() == want


def test_ties_go_to_the_earliest_start():
    tiny = unigram.Unigram(["▁", "a", "b", "ab", "▁a"], [0, 1, 2, 3, 4], [-4, -2, -2, -4, -6], [9] * 256, 10)
    assert tiny.encode("▁ab") == [0, 3] and tiny.count("▁ab") == 2  # -4 -4; ▁a b and ▁ a b weigh as much


PIECE = re.compile(fingerprints.PARAGRAPH)


def brute_fingerprints(rows):
    order = sorted(rows, key=lambda r: -r[0])
    pieces = lambda t: set(PIECE.findall(t)) or {""}
    out = {}
    for k, (i, t) in enumerate(order):
        t, other = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + other[:third]
        a, b, c = pieces(t), pieces(edited), pieces(other)
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), len(a & b) / len(a | b), len(a & c) / len(a | c))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(df).collect()}
    want = brute_fingerprints(rows)
    assert set(got) == set(want)
    for i, (n, sha, near, far) in want.items():
        assert (got[i].n_chars, got[i].edited_sha256) == (n, sha)
        assert abs(got[i].near_edited - near) < 1e-12 and abs(got[i].near_next - far) < 1e-12
    by_text = {}
    for i, t in rows:
        assert by_text.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint


def test_fingerprints(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()][:60])


def test_fingerprints_of_odd_rows(spark):
    huge = "\n".join(f"line {i} of a very long text" for i in range(9000))
    check(spark, [(i * 7 - 30, t) for i, t in enumerate([*ODD, huge, huge + "\nmore", "same", "same"])])
    check(spark, [(5, "alone and unchanged")])


def test_fingerprints_of_ids_beyond_53_bits(spark):
    draw = np.random.default_rng(1)
    check(spark, [(2**60 + 3 * i, f"text {draw.integers(0, 9)}\nof row {i}\nsame") for i in range(1000)] + [(-(2**63), "first"), (2**63 - 1, "last"), (-5, None)])


def test_fingerprints_of_mostly_missing_or_repeated_ids(spark):
    """Each row's next is the one after it in descending order of doc_id, null ids last, and of a hash within an id; the neighbours' lengths tell."""
    rows = [(None, f"null {i} " * (i % 5)) for i in range(300)] + [(7, "same")] * 300 + [(7, f"other {i}") for i in range(100)] + [(100 + i, f"own {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    placed = fingerprints.neighbours(df).collect()
    assert sum(not r._ghost for r in placed) == len(rows) and len({r._bucket for r in placed}) == sum(r._ghost for r in placed) > 10
    assert max(sum(r._bucket == b for r in placed) for b in {r._bucket for r in placed}) < 200
    order = sorted((r for r in placed if not r._ghost), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r._h, r._m))
    got = sorted((str(r.doc_id), r.edited_sha256) for r in fingerprints.edited_fingerprints(df).collect())
    want = []
    for k, r in enumerate(order):
        third = len(r.text) // 3
        want.append((str(r.doc_id), hashlib.sha256((r.text[: len(r.text) - third] + order[k - 1].text[:third]).encode()).hexdigest()))
    assert got == sorted(want)


def test_fingerprints_with_repeated_and_missing_ids(spark):
    rows = [(3, "c " * 40), (3, "c " * 40), (None, "n"), (None, None), (1, "abc"), (2, "x\ny\nz")]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprint_and_differences_recover_digests(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "b\nc\nd\ne"), (2, None, ""), (3, "\n".join(map(str, range(400))), "\n".join(map(str, range(150, 700))))], "doc_id long, x string, y string")
    made = df.select("doc_id", fingerprints.digests(F.col("x")).alias("x_keys"), fingerprints.digests(F.col("y")).alias("y_keys"))
    both = made.select("*", F.col("x_keys").alias("p"), F.col("y_keys").alias("q"), fingerprints.sketch(F.col("x_keys")).alias("x_cells"), fingerprints.sketch(F.col("y_keys")).alias("y_cells"))
    for r in fingerprints.differences(both, {"d": ("x", "y")}).collect():
        assert {d.k for d in r.d if d.n == 1} == set(r.p) - set(r.q) and {d.k for d in r.d if d.n == -1} == set(r.q) - set(r.p)
    none = made.where("doc_id = 1").select("doc_id", "x_keys", F.lit(None).cast("array<bigint>").alias("y_keys"), fingerprints.sketch(F.col("x_keys")).alias("x_cells"), F.lit(None).cast("array<struct<n:int,x:bigint>>").alias("y_cells"))
    assert [len(r.d) for r in fingerprints.differences(none, {"d": ("x", "y")}).collect()] == [3]
    df = df.withColumn("keys", F.lit(1)).withColumn("_keys", F.lit(2))
    named = fingerprints.fingerprint(df, "x")
    assert named.columns == [*df.columns, "fingerprint"] and len({r.fingerprint for r in named.collect()}) == 3


def test_fingerprints_use_no_python(spark):
    plan = fingerprints.edited_fingerprints(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_queries(spark):
    assert {r.round_trip for r in queries.op9_sentencepieces(spark, SMALL).select("round_trip").distinct().collect()} == {True}
    assert queries.op4_token_counts(spark, SMALL).count() == 200
