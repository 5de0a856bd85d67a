"""Best-fit packing of tokenized documents into sequences of one length.

Documents are encoded where they are read and cut into pieces of at most `capacity` tokens; pieces carry no text from there on. A piece goes into
the sequence with the smallest gap that holds it, the longest pieces first; where no gap holds it, a new sequence begins.

Lengths and gaps are whole numbers up to the capacity, so sorting them by range is counting them: all pieces of a length are one run, and so are all
sequences of a gap that have the same history. The successor sweep goes down the runs of pieces; each finds the smallest gap that is not smaller than its length, the k-th
piece of a run takes the k-th place in the gap's run, the gaps are updated, and what is left of the run looks on. This settles all pieces of a
run at once, and its result is the one that piece by piece best fit in descending order has. The runs are at most `capacity` rows, whatever the
number of documents; everything that has a row for each piece is counted, ranked and assigned in parallel.

A piece's rank in its run is the sum of the run's counts in the batches before its own and its place in its batch: no task sorts a run, however many pieces
have the same length.

Cases: a null or empty text is the end token alone; rows that repeat are documents of their own; rows without doc_id are packed and have none; a document of
exactly the capacity fills a sequence; an empty table gives an empty result; other columns of documents are not read.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import alone, binary, chunks, shared_table

CAPACITY = 2048
#: The id that ends every document.
END = 0
#: Words whose ids a Python worker keeps, and the bytes of these words and ids; beyond either the cache starts anew.
CACHED_WORDS, CACHED_BYTES = 1_000_000, 48 << 20
#: Flows up to which they are broadcast; beyond, they are joined.
BROADCAST_FLOWS = 500_000

FLOWS = "length long, first long, n long, sequence long, per long, at long"


class WordIds(dict):
    """Word (bytes) -> its ids as little-endian 32-bit numbers, by a tokenizer that drops white space and never joins what it parts."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path, self.held, self.tokenizer = path, 0, Tokenizer.from_file(path)

    def learn(self, words: set[bytes]) -> None:
        """Adds the words that are not known yet; they are encoded as one text, whose offsets tell which ids are whose."""
        new = [w for w in words if w not in self]
        if not new:
            return
        if len(self) + len(new) > CACHED_WORDS or self.held > CACHED_BYTES:
            self.clear()
            self.held, new = 0, list(words)
        texts = [w.decode() for w in new]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
        ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = [0, *np.searchsorted(starts, ends).tolist()]
        data = ids.tobytes()
        self.update((w, data[4 * a : 4 * b]) for w, a, b in zip(new, cuts[:-1], cuts[1:], strict=True))
        self.held += sum(map(len, new)) + len(data)

    def of(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """The ids of each text, without an end."""
        for a, b in chunks(texts):
            parted = [t.split() if t else [] for t in texts[a:b]]
            self.learn(set().union(*parted))
            for words in parted:
                yield b"".join(map(self.__getitem__, words))


_known: list[WordIds] = []


def word_ids(path: str) -> WordIds:
    """This worker's cache for a tokenizer."""
    if not _known or _known[0].path != path:
        _known[:] = [WordIds(path)]
    return alone(_known[0])


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of documents (doc_id, text), with ids its ids too, and batch and place: how many pieces of its length
    stand before it among those that were encoded together. Written."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    end = np.array([END], "<u4").tobytes()

    def encoded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            of = word_ids(path)
            doc, number, length, crc, held = [], [], [], [], []
            for i, data in enumerate(of.of(binary(part["text"]))):
                data += end
                for k, a in enumerate(range(0, len(data), 4 * capacity)):
                    cut = data[a : a + 4 * capacity]
                    doc.append(i)
                    number.append(k)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                    if ids:
                        held.append(np.frombuffer(cut, "<i4"))
            size, k = np.array(length, np.int64), np.array(number, np.int64)
            order = np.argsort(size, kind="stable")
            begins = np.flatnonzero(np.r_[True, np.diff(size[order]) != 0])
            place = np.empty(len(size), np.int64)
            place[order] = np.arange(len(size)) - np.repeat(begins, np.diff(np.r_[begins, len(size)]))
            columns = [part["doc_id"].take(pa.array(doc)), pa.array(k.astype(np.int32)), pa.array(k * capacity), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.full(len(size), part["row"][0].as_py(), np.int64)), pa.array(place)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "batch", "place"]
            if ids:
                columns.append(pa.array(held, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, batch long, place long" + ", ids array<int>" * ids
    rows = documents.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return shared_table(rows.mapInArrow(encoded, schema), "pieces")


def sweep(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, of counts[i] pieces of lengths[i]: flows (length, first, n, sequence, per, at).

    A flow puts the pieces of its length with ranks from first to first + n - 1 into the sequences from `sequence` on, `per` to each, one behind the other from `at` on.
    """
    flows, opened = [], 0
    gaps: list[int] = []  # ascending
    runs: dict[int, list[list[int]]] = {}  # by gap: runs (first sequence, number)

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in runs:
                bisect.insort(gaps, gap)
            runs.setdefault(gap, []).append([first, number])

    for length, left in sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True):
        rank = 0
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, number = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap]
                    gaps.pop(at)
            else:
                gap, first, number = capacity, opened, -(-left // (capacity // length))
                opened += number
            per = gap // length
            full = min(number, left // per)
            if full:
                flows.append((length, rank, full * per, first, per, capacity - gap))
                leave(gap - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < number and left:  # fewer than `per` are left: they share one sequence
                flows.append((length, rank, left, first + full, per, capacity - gap))
                leave(gap - left * length, first + full, 1)
                leave(gap, first + full + 1, number - full - 1)
                left = 0
            else:
                leave(gap, first + full, number - full)
    return flows


def assigned(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (length, batch, place, ...; read more than once, so written) with sequence_id and offset instead of batch and place."""
    runs = shared_table(rows.groupBy("batch", "length").agg(F.count("*").alias("n")), "runs")

    def swept(part: pa.Table) -> pa.Table:
        flows = sweep(part["length"].to_numpy(), part["n"].to_numpy(), capacity)
        names = [x.split()[0] for x in FLOWS.split(", ")]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(names, zip(*flows, strict=True), strict=True)})

    # one row for each length, so at most as many as a sequence has tokens
    flows = shared_table(runs.groupBy("length").agg(F.sum("n").alias("n")).groupBy().applyInArrow(swept, FLOWS), "flows")
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("batch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.join(runs.select("batch", "length", before.alias("_before")), ["batch", "length"]).withColumn("_rank", F.col("_before") + F.col("place")).drop("batch", "place", "_before")
    flows = flows.withColumnRenamed("length", "_length")
    flows = F.broadcast(flows) if flows.count() <= BROADCAST_FLOWS else flows
    met = ranked.join(flows, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("first") + F.col("n")))
    at = F.col("_rank") - F.col("first")
    placed = met.withColumn("sequence_id", (F.col("sequence") + F.floor(at / F.col("per"))).cast("long")).withColumn("offset", F.col("at") + at % F.col("per") * F.col("length"))
    return placed.select(*(c for c in rows.columns if c not in ("batch", "place")), "sequence_id", "offset")


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for) for each piece of documents (doc_id, text).

    path: a tokenizer's file for the tokenizers library, of the kind that drops white space.
    """
    return assigned(pieces(documents, path, capacity, ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, doc_ids and ids of each sequence of pack(..., ids=True), in order; a sequence has at most `capacity` tokens."""
    by = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("_held"))
    return by.select("sequence_id", "n_tokens", F.transform("_held", lambda x: x["doc_id"]).alias("doc_ids"), F.flatten(F.transform("_held", lambda x: x["ids"])).alias("ids"))
