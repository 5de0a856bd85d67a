"""SentencePiece unigram encoding and decoding; giant texts by a max-plus parallel scan.

An ordinary text is encoded stretch by stretch, with the stretches a worker has met kept. A giant text is split into chunks of equal length. At a boundary the
state is how far back the last cut between two pieces lies, fewer than the longest piece's characters. Each chunk yields the matrix
of best sums from each state before it to each state after it. Max-plus products of FAN matrices each go up a tree, whose groups are tasks, and
true sums come down it to every boundary; with them each chunk settles its own back pointers, the states that the best path passes follow from
the chunks' maps from exit to entry, composed up and down the same tree, and every chunk is traced back by itself. Weights are whole numbers, so
the result equals a single pass over the whole text, ties included.

Decoding joins what the ids stand for and drops the space in front; it gives the text back, except that U+2581 becomes a space.

Cases: a null or empty text has no ids and decodes to an empty text; unknown characters become their UTF-8 bytes; other columns and
repeated rows pass through, whatever these columns are called, but for those called as the added ones, which give way; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import alone, free, others, releasing, shared_table
from tidewater.llm.unigram import NONE, SPACE, STRETCH, Unigram, escaped, load

#: Code points from which a text is encoded in chunks, and those of a chunk.
GIANT_CHARS = 65_536
CHUNK_CHARS = 8_192
#: Rows whose ids a worker makes at once.
SLICE = 500
#: Matrices or maps that a node of the tree combines, and chunks that a task works through.
FAN, TASK_CHUNKS = 64, 16
#: Where a cut is certain: before a space that follows another character, and around a line break.
_CERTAIN = re.compile("(?<=[^▁])(?=▁)|(?<=\n)|(?=\n)")


def _list_array(parts: list[bytes]) -> pa.Array:
    """list<int> from the bytes of each row's ids."""
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def _text_array(parts: list[bytes], spelled: list[bytes]) -> pa.Array:
    """What the ids (as bytes) of each row stand for, without the space in front."""
    get = spelled.__getitem__
    said = [b"".join(map(get, np.frombuffer(p, "<i4").tolist())).removeprefix(b" ") for p in parts]
    return pa.array(said, pa.binary()).cast(pa.string())


def _ordinary(sent, decoded: bool):
    """ids, and with `decoded` what they decode to as well, made by the same worker. Rows are taken SLICE at a time to hold little at once."""

    @releasing
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        known, find = alone(model.known_ids).__getitem__, STRETCH.findall
        for batch in batches:
            ids, said = [], []
            for a in range(0, max(1, len(batch)), SLICE):
                parts = [b"".join(map(known, find(escaped(t)))) if t else b"" for t in batch.slice(a, SLICE).to_pylist()]
                ids.append(_list_array(parts))
                said.append(_text_array(parts, model.spelled) if decoded else pa.nulls(len(parts), pa.string()))
            yield pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(said)], ["ids", "decoded"])

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from encoded(batches)

    return encode


def transfer(model: Unigram, text: str, before: int) -> np.ndarray:
    """Best sums [state before, state after] over a chunk; text begins with `before` characters of what precedes it.

    Up to the first certain cut the sums depend on the state before the chunk; from there on they all run through that cut.
    """
    most, n = model.longest, len(text) - before
    cut = _CERTAIN.search(text, max(before, 1))
    fixed = cut.start() - before if cut else n
    matches = model.matches(text)
    sums = np.full((fixed + most, most), NONE, np.int64)  # row most - 1 + i: cuts after i characters of the chunk
    sums[np.arange(most), most - 1 - np.arange(most)] = 0  # state s: the last cut lies s characters before the chunk
    for end in range(before + 1, before + fixed + 1):
        if pieces := matches[end]:
            at = end - before + most - 1
            sums[at] = (sums[[at - length for length, _, _ in pieces]] + np.array([[w] for _, w, _ in pieces])).max(0)
    if fixed == n:
        return np.maximum(sums[-1 : -most - 1 : -1].T, NONE)
    onward = [NONE] * (most - 1) + [0] + [NONE] * (n - fixed)  # as above, from the certain cut
    for end in range(before + fixed + 1, len(text) + 1):
        at = end - before - fixed + most - 1
        onward[at] = max([onward[at - length] + weight for length, weight, _ in matches[end]], default=NONE)
    return np.maximum(sums[-1][:, None] + np.array(onward[: -most - 1 : -1])[None, :], NONE)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of the last two axes."""
    return np.maximum((a[..., :, :, None] + b[..., None, :, :]).max(-2), NONE)


def settle(model: Unigram, text: str, before: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """With the true sums at the chunk's start: length and id of the best last piece at each end, and the entry state of each exit state."""
    most, n = model.longest, len(text) - before
    sums = [*(int(x) for x in start[::-1]), *[NONE] * n]
    lengths, ids = np.zeros(n + 1, np.uint8), np.zeros(n + 1, np.int32)
    for end, pieces in enumerate(model.matches(text)):
        if end > before:
            at, top = end - before + most - 1, None
            for length, weight, piece in pieces:
                if (total := sums[at - length] + weight) > (NONE // 2 if top is None else top):
                    top = total
                    lengths[end - before], ids[end - before] = length, piece
            if top is not None:
                sums[at] = top
    entry = np.full(most, -1, np.int64)
    for state in range(min(most, n)):
        at = n - state
        while at > 0 and lengths[at]:
            at -= int(lengths[at])
        if at <= 0:
            entry[state] = -at
    return lengths, ids, entry


def trace(model: Unigram, text: str, before: int, lengths: np.ndarray, ids: np.ndarray, exit_state: int) -> list[int]:
    """Ids of the pieces that end in the chunk, on the path that leaves it in exit_state."""
    out, at = [], len(text) - before - exit_state
    while at > 0:
        piece = int(ids[at])
        out += [piece] if piece >= 0 else [model.byte_ids[b] for b in reversed(text[before + at - 1].encode())]
        at -= int(lengths[at])
    return out[::-1]


def _up(level: DataFrame, kind: str, combined) -> DataFrame:
    """level (row, k, value): FAN neighbours each combined to one."""

    def node(part: pa.Table) -> pa.Table:
        part = part.sort_by("k")
        return pa.table({"row": part["row"].slice(0, 1), "k": pa.array([part["k"][0].as_py() // FAN], pa.int64()), "value": pa.array([combined(part["value"].to_pylist())], pa.binary())})

    return level.groupBy("row", F.floor(F.col("k") / FAN)).applyInArrow(node, f"row long, k long, value {kind}")


def _down(level: DataFrame, above: DataFrame | None, kind: str, passed) -> DataFrame:
    """level with a column state: what comes to each node from above (nothing above: to the whole), passed on from node to node."""

    def node(left: pa.Table, right: pa.Table | None) -> pa.Table:
        left = left.sort_by("k")
        return pa.table({"row": left["row"], "k": left["k"], "state": pa.array(passed(left["value"].to_pylist(), right["state"][0].as_py() if right is not None and right.num_rows else None), pa.binary())})

    schema = f"row long, k long, state {kind}"
    if above is None:
        return level.groupBy("row").applyInArrow(lambda part: node(part, None), schema)
    return level.groupBy("row", F.floor(F.col("k") / FAN)).cogroup(above.groupBy("row", "k")).applyInArrow(node, schema)


def _scan(leaves: DataFrame, chunks: int, combined, passed) -> DataFrame:
    """row, k, state of each leaf (row, k, value binary), of which no row has more than `chunks`: up the tree, then down."""
    levels = [shared_table(leaves, "leaves")]
    while chunks > FAN:
        levels.append(shared_table(_up(levels[-1], "binary", combined), "nodes"))
        chunks = -(-chunks // FAN)
    found = None
    for level in reversed(levels):
        found = _down(level, found, "binary", passed)
    return found


def _giant(rows: DataFrame, sent, most: int, chunk: int) -> DataFrame:
    """row, ids (array<int>) of the giant rows (row, text with spaces escaped)."""
    n = F.ceil(F.length("text") / chunk)
    cut = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    before = F.least(F.lit(most - 1), F.col("k") * chunk).cast("int")
    at = (F.col("k") * chunk + 1).cast("int") - before
    parts = shared_table(cut.select("row", "k", before.alias("before"), F.substring(F.col("text"), at, before + chunk).alias("part")), "chunks")
    count, last = parts.agg(F.count("*"), F.max("k")).first()
    tasks = max(1, -(-count // TASK_CHUNKS))  # given, so that few bytes of hard work are not gathered in one task
    chunks = (last or 0) + 1

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [transfer(sent.value, t, b).tobytes() for t, b in zip(batch["part"].to_pylist(), batch["before"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["k"], pa.array(made, pa.binary())], ["row", "k", "value"])

    square = lambda x: np.frombuffer(x, np.int64).reshape(most, most)

    def multiplied(values: list[bytes]) -> bytes:
        found = square(values[0])
        for x in values[1:]:
            found = product(found, square(x))
        return found.tobytes()

    def sums(values: list[bytes], first: bytes | None) -> list[bytes]:
        """True sums before each of the chunks (or spans of them)."""
        if first is None:
            now = np.full(most, NONE, np.int64)
            now[0] = 0
        else:
            now = np.frombuffer(first, np.int64)
        out = []
        for x in values:
            out.append(now.tobytes())
            now = np.maximum((now[:, None] + square(x)).max(0), NONE)
        return out

    def pointers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [settle(sent.value, t, b, np.frombuffer(s, np.int64)) for t, b, s in zip(batch["part"].to_pylist(), batch["before"].to_pylist(), batch["state"].to_pylist(), strict=True)]
            columns = [pa.array([x[i].tobytes() for x in made], pa.binary()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("row", "k", "before", "part")), *columns], ["row", "k", "before", "part", "lengths", "pieces", "value"])

    def composed(values: list[bytes]) -> bytes:
        """The entry of each exit state over several chunks; -1 stays."""
        found = np.arange(most)
        for x in reversed(values):
            found = np.where(found < 0, -1, np.frombuffer(x, np.int64)[found])
        return found.tobytes()

    def exits(values: list[bytes], state: bytes | None) -> list[bytes]:
        now, out = 0 if state is None else int(np.frombuffer(state, np.int64)[0]), []
        for x in reversed(values):
            out.append(np.array([now], np.int64).tobytes())
            now = int(np.frombuffer(x, np.int64)[now])
        return out[::-1]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t, b, lengths, ids, state in zip(*(batch[c].to_pylist() for c in ("part", "before", "lengths", "pieces", "state")), strict=True):
                made.append(np.array(trace(sent.value, t, b, np.frombuffer(lengths, np.uint8), np.frombuffer(ids, np.int32), int(np.frombuffer(state, np.int64)[0])), "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch["row"], batch["k"], _list_array(made)], ["row", "k", "some"])

    starts = _scan(parts.repartition(tasks, "row", "k").mapInArrow(matrices, "row long, k long, value binary"), chunks, multiplied, sums)
    met = parts.join(starts, ["row", "k"]).repartition(tasks, "row", "k")
    settled = shared_table(met.mapInArrow(pointers, "row long, k long, before int, part string, lengths binary, pieces binary, value binary"), "settled")
    left = _scan(settled.select("row", "k", "value"), chunks, composed, exits)
    traced = settled.join(left, ["row", "k"]).mapInArrow(pieces, "row long, k long, some array<int>")
    # a row of the result holds all ids of its text, as for any other text
    return traced.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "some"))), lambda x: x["some"])).alias("ids"))


def encode(documents: DataFrame, text: str = "text", to: str = "ids", model: Unigram | None = None, giant: int = GIANT_CHARS, chunk: int = CHUNK_CHARS, decoded: str | None = None) -> DataFrame:
    """documents with a column of ids (array<int>), and with what they decode to where a name for that is given."""
    model = model or load()
    if chunk < model.longest:
        raise ValueError("a chunk is shorter than a piece")
    sent = documents.sparkSession.sparkContext.broadcast(model)  # a vocabulary: its size is fixed
    is_giant = F.coalesce(F.length(text) > giant, F.lit(False))
    rest = others(documents.columns, to, decoded)
    made, row, ids = free([*documents.columns, to, decoded or to], "made", "row", "ids")
    ordinary = documents.where(~is_giant).withColumn(made, _ordinary(sent, decoded is not None)(F.col(text)))
    ordinary = ordinary.select(*rest, F.col(made)["ids"].alias(to), *([F.col(made)["decoded"].alias(decoded)] if decoded else []))
    large = shared_table(documents.where(is_giant).withColumn(row, F.monotonically_increasing_id()), "giants")
    marked = large.select(F.col(row).alias("row"), F.concat(F.lit(SPACE), F.replace(F.col(text), F.lit(" "), F.lit(SPACE))).alias("text"))
    found = _giant(marked, sent, model.longest, chunk).select(F.col("row").alias(row), F.col("ids").alias(ids))
    whole = large.join(found, row).select(*rest, F.col(ids).alias(to))
    if decoded:
        whole = whole.withColumn(decoded, decoder(documents.sparkSession, model)(F.col(to)))
    return ordinary.union(whole)


def decoder(spark, model: Unigram | None = None):
    """A function from a column of ids to the column of texts."""
    sent = spark.sparkContext.broadcast((model or load()).spelled)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spelled = sent.value
        for batch in batches:
            made = []
            for a in range(0, max(1, len(batch)), SLICE):
                made.append(_text_array([np.array(x or (), "<i4").tobytes() for x in batch.slice(a, SLICE).to_pylist()], spelled))
            yield pa.concat_arrays(made)

    return decode
