"""Token counts without tokens: Aho-Corasick finds the vocabulary's pieces, and a Viterbi pass carries the best sum and its number of pieces.

Whole texts are counted. A text falls into stretches that no piece reaches across; a worker keeps the counts of the stretches it
has met, up to a bound.

Cases: a null or empty text has 0 tokens; unknown characters count one token for each UTF-8 byte; texts of any length pass in
time that grows with their length; a column that is called as the one of the counts gives way to it, other columns and repeated rows pass through; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import alone, others
from tidewater.llm.unigram import STRETCH, Unigram, escaped, load


def counter(spark, model: Unigram | None = None):
    """A function from a text column to the column of token counts."""
    sent = spark.sparkContext.broadcast(model or load())  # a vocabulary: its size is fixed

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = alone(sent.value.known_counts).__getitem__
        find = STRETCH.findall
        for batch in batches:
            yield pa.array([sum(map(known, find(escaped(t)))) if t else 0 for t in batch.to_pylist()], pa.int64())

    return count


def count_tokens(documents: DataFrame, text: str = "text", to: str = "n_tokens", model: Unigram | None = None) -> DataFrame:
    """documents with a column of token counts."""
    return documents.select(*others(documents.columns, to), counter(documents.sparkSession, model)(F.col(text)).alias(to))
