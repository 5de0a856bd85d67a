"""Quality classifier: hashed word n-gram logistic regression, fitted with follow-the-regularised-leader updates.

Features of a text: its words and their punctuation runs, and pairs of neighbours, hashed to 2**BITS slots. A slot's value is
its count over the square root of the number of tokens. The score is the logistic function of a sparse dot product.

Cases: a null or empty text has no feature and gets the score of the bias; texts are used whole; labels that are null or whose
doc_id is null are not learnt from; an id that is labelled more than once takes its lowest label; rows that repeat doc_id and text are learnt once; with no labels
every score is 0.5; a column that is called as the one of the scores gives way to it, other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import CACHED_WORDS, CHUNK_ROWS, alone, binary, chunks, mix, others, releasing, remainder, shared_table

#: Feature slots: 2**BITS.
BITS = 20
#: At most about so many labelled rows, and characters of them, are learnt from; more are thinned by a hash of doc_id, and what several texts of an id leave by one of doc_id and text.
MAX_TRAIN_ROWS, MAX_TRAIN_CHARS = 20_000, 160_000_000
#: Models fitted side by side on disjoint rows, then averaged.
SHARDS = 4
EPOCHS = 4
#: Of the updates: learning rate, its smoothing, and the strengths of the two regularisers.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01

_TOKEN = re.compile(rb"[\w\x80-\xff]+|[^\w\s\x80-\xff]+")
_PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Stands for every pair of a token with itself, so that repetition is learnt apart from the word that is repeated.
_AGAIN = np.uint64(0xD1B54A32D192ED03)


class _Tokens(dict):
    """White-space word -> the hashes of its tokens (letters and digits, or runs of punctuation), 8 bytes each."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = b"".join(xxhash.xxh64_intdigest(t).to_bytes(8, "little") for t in _TOKEN.findall(word))
        return found


_tokens = _Tokens()


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all features of all texts after each other, where each text's begin (one more at the end), and tokens of each text."""
    get = alone(_tokens).__getitem__
    parts = [b"".join(map(get, t.lower().split())) if t else b"" for t in texts]
    flat = np.frombuffer(b"".join(parts), "<u8")
    n = np.fromiter(map(len, parts), np.int64, len(parts)) // 8
    ends = np.cumsum(n)
    pairs = mix(np.where(flat[:-1] == flat[1:], _AGAIN, flat[:-1] * _PAIR + flat[1:])) if len(flat) else flat
    inside = np.ones(len(pairs), bool)  # pairs across two texts are none
    cuts = ends[:-1]
    inside[cuts[(cuts > 0) & (cuts < len(flat))] - 1] = False
    shift = np.uint64(64 - BITS)
    text_of = np.repeat(np.arange(len(texts)), n)
    slots = np.concatenate([mix(flat) >> shift, pairs[inside] >> shift]).astype(np.int64)
    owner = np.concatenate([text_of, text_of[: len(pairs)][inside]])
    order = np.argsort(owner, kind="stable")
    begins = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    return slots[order], begins, n


def _follow(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int) -> np.ndarray:
    """Weights (the bias last) after the updates over rows of (slots, values, label)."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    bias = np.array([size - 1])

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for slots, values, label in rows:
            i, x = np.concatenate([slots, bias]), np.concatenate([values, [1.0]])
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / ALPHA * w
            n[i] = grown
    return weights(np.arange(size))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS, max_chars: int = MAX_TRAIN_CHARS, shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learnt from the labelled documents whose crc32(doc_id) mod 5 is not 0, of about max_rows of them and max_chars characters at most."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("_label"))
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003))
    met = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by max_rows ids
    # rows that repeat become one before they are shuffled
    single = met.groupBy("doc_id", F.xxhash64("text").alias("_h"), F.length("text").alias("_chars")).agg(F.first("text").alias("text"), F.first("_label").alias("_label"))
    labelled = shared_table(single, "labelled")
    n, chars = labelled.agg(F.count("*"), F.sum("_chars")).first()
    # an id may have many texts, and texts may be long
    share = min(1.0, 1.1 * max_rows / max(1, n), max_chars / max(1, chars or 0))
    rows = labelled if share == 1 else labelled.where(F.pmod(F.xxhash64(F.lit(29), "doc_id", "_h"), F.lit(1_000_003)) < int(share * 1_000_003))

    def learn(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_order", "doc_id", "_h"], kind="stable")
        made = []
        for text, y in zip(part["text"], part["_label"], strict=True):
            slots, _, n = features([text.encode() if text else None])
            i, c = np.unique(slots, return_counts=True)
            made.append((i, c / np.sqrt(max(1, n[0])), int(y)))
        w = _follow(made, epochs)
        i = np.flatnonzero(w)
        return pd.DataFrame({"slot": i, "weight": w[i]})

    parts = rows.select("doc_id", "_h", "text", "_label", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("_shard"), F.xxhash64(F.lit(7), "doc_id").alias("_order"))
    found = parts.groupBy("_shard").applyInPandas(learn, "slot long, weight double")
    # each slot's mean over the shards; at most 2**BITS + 1 rows come to the driver
    mean = found.groupBy("slot").agg((F.sum("weight") / shards).alias("weight")).toPandas()
    w = np.zeros((1 << BITS) + 1, np.float32)
    w[mean["slot"].to_numpy(np.int64)] = mean["weight"]
    return w


def scorer(spark, weights: np.ndarray):
    """A function from a text column to the column of scores in 0 to 1."""
    sent = spark.sparkContext.broadcast(weights.astype(np.float32))  # 2**BITS floats: a fixed 4 MB

    @releasing
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = sent.value
        for batch in batches:
            out = np.zeros(len(batch))
            for at in range(0, len(batch), CHUNK_ROWS):
                texts = binary(batch.slice(at, CHUNK_ROWS))
                for a, b in chunks(texts):
                    slots, begins, n = features(texts[a:b])
                    sums = np.concatenate([[0.0], np.cumsum(w[slots], dtype=np.float64)])
                    out[at + a : at + b] = (sums[begins[1:]] - sums[begins[:-1]]) / np.sqrt(np.maximum(1, n))
            yield pa.array(1 / (1 + np.exp(-np.clip(out + float(w[-1]), -35, 35))))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from scored(batches)

    return score


def score_documents(documents: DataFrame, weights: np.ndarray, text: str = "text", to: str = "score") -> DataFrame:
    """documents with a column of scores, which replaces one that is called so."""
    score = scorer(documents.sparkSession, weights)
    return documents.select(*others(documents.columns, to), score(F.col(text)).alias(to))


def predicted(score: Column, threshold: float = 0.3) -> Column:
    return (score >= threshold).cast("int")
