"""Line dedup over a sharded minimal perfect hash of all distinct lines.

The distinct line hashes are counted, dealt into shards by hash, and each shard becomes one row: a minimal perfect hash with an
array of fingerprints and an array of document counts. Documents are dealt into blocks; each block asks every shard once for the
lines it holds, the shards answer from their arrays with the lines to drop, and each block drops them. Lines of very many documents, which nearly
every block would ask for, are told to all blocks instead, up to a number of them, so that a shard's work does not grow with the blocks.

Cases: a null or empty text is one empty line; a line's key is the line stripped of ASCII white space with A-Z lower-cased; keys
shorter than min_chars code points are never dropped; every row counts as a document of its own, so repeated rows count apart;
an empty table stays empty; other columns pass through unchanged, whatever they are called, but for those called as the two columns that are added,
which give way to them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import UPPER, binary, free, mix, others, partitions, release, shared_table

#: Distinct lines of a shard, about: so many that its arrays take a few MB.
SHARD_LINES = 250_000
#: Documents of a block and their characters, about; a block of more than OVERFULL times either is dealt into parts.
BLOCK_ROWS, BLOCK_CHARS, OVERFULL = 1_000, 4_000_000, 3
#: Bits of a level of the perfect hash for each key that has no place yet.
GAMMA = 2.0
#: Lines of the most documents that all blocks know, at most, and documents of such a line at least: these are not probed.
HOT_LINES, HOT_DOCS = 100_000, 64
MIN_DOCS = 10
MIN_CHARS = 1
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64(level * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray, counts: np.ndarray) -> dict:
    """A minimal perfect hash of distinct 64-bit keys. On each level a key has a slot; those alone in theirs stay, the others go on.

    sizes and bits: the levels' slots and which of them hold a key; a key's place is the number of held slots before its own.
    """
    sizes, held, rest = [], [], keys
    while len(rest):
        size = max(8, int(GAMMA * len(rest)))
        at = _slots(rest, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        held.append(alone)
        rest = rest[~alone[at]]
    bits = np.concatenate(held) if held else np.zeros(0, bool)
    table = {"sizes": np.array(sizes, np.int64), "bits": np.packbits(bits)}
    place = look(table, keys)
    prints, found = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64)
    prints[place], found[place] = _print(keys), counts
    narrow = np.uint32 if not len(counts) or counts.max() < 2**32 else np.int64
    return table | {"prints": prints, "counts": found.astype(narrow)}


def look(table: dict, keys: np.ndarray) -> np.ndarray:
    """The keys' places; -1 for a key that no level holds."""
    bits = np.unpackbits(table["bits"]).astype(bool)
    before = np.concatenate([[0], np.cumsum(bits)])
    place, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(table["sizes"]):
        at = _slots(keys[open_], level, int(size)) + base
        here = bits[at]
        place[open_[here]] = before[at[here]]
        open_, base = open_[~here], base + int(size)
    return place


def _print(keys: np.ndarray) -> np.ndarray:
    """Fingerprints: 32 bits that the slots do not follow from."""
    return (mix(keys ^ np.uint64(0xA5A5A5A5DEADBEEF)) >> np.uint64(32)).astype(np.uint32)


def count_of(table: dict, keys: np.ndarray) -> np.ndarray:
    """Document counts of keys; 0 where the fingerprint says that a key is not in the table."""
    place = look(table, keys)
    if not len(table["prints"]):
        return np.zeros(len(keys), np.int64)
    right = (place >= 0) & (table["prints"][place] == _print(keys))
    return np.where(right, table["counts"][place].astype(np.int64), 0)


def line_keys(documents: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """place, chars, keys (hashes of the distinct keys of a text's lines) of each row; written once, as shards, probes and blocks all come from it."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), line_key)
    keys = F.array_distinct(F.transform(F.filter(lines, lambda k: F.char_length(k) >= min_chars), lambda k: F.xxhash64(k)))
    return shared_table(documents.select(_place(documents, text).alias("place"), F.coalesce(F.length(text), F.lit(0)).alias("chars"), keys.alias("keys")), "keys")


def _place(documents: DataFrame, text: str) -> Column:
    """What decides a row's block: the same for equal rows."""
    return F.xxhash64(F.lit(3), *([F.col("doc_id")] if "doc_id" in documents.columns else []), F.substring(F.col(text), 1, 64), F.length(text))


def line_tables(rows: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """Of rows (keys) one row for each shard: shard long, sizes, bits, prints, counts binary. The number of shards, and the counts (key, n_docs) that they hold."""
    counted = shared_table(rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n_docs")), "lines")
    shards = max(1, -(-counted.count() // SHARD_LINES))

    def pack(part: pa.Table) -> pa.Table:
        keys = part["key"].to_numpy().view(np.uint64)
        table = build(keys, part["n_docs"].to_numpy())
        return pa.table({"shard": part["shard"].slice(0, 1).cast(pa.int64()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in table.items()}, "wide": pa.array([table["counts"].itemsize == 8])})

    dealt = counted.withColumn("shard", F.pmod("key", F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(pack, "shard long, sizes binary, bits binary, prints binary, counts binary, wide boolean"), shards, counted


def hot_lines(counted: DataFrame, min_docs: int) -> np.ndarray:
    """Ascending keys of the lines that 2**k documents or more hold, with the least k that leaves HOT_LINES of them. A shard would answer for such a line once for each block."""
    least = max(min_docs, HOT_DOCS)
    steps = [least << k for k in range(62 - least.bit_length())]
    numbers = counted.agg(*[F.count_if(F.col("n_docs") >= n).alias(f"n{n}") for n in steps]).first()
    fit = next((n for n, found in zip(steps, numbers, strict=True) if found <= HOT_LINES), None)
    return np.sort(counted.where(F.col("n_docs") >= fit).select("key").toPandas()["key"].to_numpy(np.int64)) if fit else np.zeros(0, np.int64)


def _unpack(row: dict) -> dict:
    kinds = {"sizes": np.int64, "bits": np.uint8, "prints": np.uint32, "counts": np.int64 if row["wide"] else np.uint32}
    return {k: np.frombuffer(row[k], kind) for k, kind in kinds.items()}


def _hash(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, 42)  # as Spark's xxhash64


def drop_lines(documents: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, lines: str = "_lines", dropped: str = "_dropped") -> DataFrame:
    """documents with the columns `lines` long (lines before), `dropped` long, and text without the lines whose key min_docs documents hold."""
    spark = documents.sparkSession
    columns = others(documents.columns, lines, dropped)
    documents = documents.select(*columns)
    block_c, part_c = free([*columns, lines, dropped], "block", "part")
    rows = line_keys(documents, text, min_chars)
    tables, shards, counted = line_tables(rows)
    often = hot_lines(counted, min_docs)
    sent = spark.sparkContext.broadcast(frozenset(often.view(np.uint64).tolist()))  # HOT_LINES at most
    known = F.broadcast(spark.createDataFrame(pd.DataFrame({"key": often}), "key long"))
    n, chars = rows.agg(F.count("*"), F.sum("chars")).first()
    blocks = max(-(-n // BLOCK_ROWS), (chars or 0) // BLOCK_CHARS, 4 * partitions(spark))
    block_of = lambda place: F.pmod(place, F.lit(blocks))
    probes = rows.select(block_of(F.col("place")).alias("block"), F.explode("keys").alias("key")).join(known, "key", "left_anti").distinct().withColumn("shard", F.pmod("key", F.lit(shards)))
    # a block that repeated rows or long texts overfill is dealt into parts, each of which gets all of its verdicts
    held = rows.groupBy(block_of(F.col("place")).alias("block")).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    full = F.greatest(F.col("n") / BLOCK_ROWS, F.col("chars") / BLOCK_CHARS)
    parts = shared_table(held.where(full > OVERFULL).select("block", F.ceil(full).cast("long").alias("parts")), "overfull")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "key": pa.array([], pa.int64())})
        keys = left["key"].to_numpy()
        common = count_of(_unpack(right.to_pylist()[0]), keys.view(np.uint64)) >= min_docs
        return pa.table({"block": left["block"].to_numpy()[common], "key": keys[common]})

    found = probes.groupBy("shard").cogroup(tables.groupBy("shard")).applyInArrow(answer, "block long, key long").join(parts, "block", "left")
    verdicts = found.select("block", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))

    def dropped_from(left: pa.Table, right: pa.Table) -> pa.Table:
        hot, often = frozenset(right["key"].to_numpy().view(np.uint64).tolist()), sent.value
        before, gone, out = [], [], []
        for t in binary(left[text]):
            every = (t or b"").split(b"\n")
            # a key shorter than min_chars is in no table, so never among the hot ones
            stay = [x for x, h in zip(every, map(_hash, map(bytes.lower, map(bytes.strip, every))), strict=True) if h not in often and h not in hot] if hot or often else every
            before.append(len(every))
            gone.append(len(every) - len(stay))
            out.append(b"\n".join(stay))
        made = {c: pa.array(out, pa.binary()).cast(pa.string()) if c == text else left[c] for c in columns}
        return pa.table(made | {lines: pa.array(before, pa.int64()), dropped: pa.array(gone, pa.int64())})

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        found = dropped_from(left, right)
        release()
        return found

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in documents.schema), T.StructField(lines, T.LongType()), T.StructField(dropped, T.LongType())])
    dealt = documents.withColumn(block_c, block_of(_place(documents, text)))
    if parts.head(1):
        several = parts.select(F.col("block").alias(block_c), F.col("parts").alias(part_c))
        dealt = dealt.join(several, block_c, "left").withColumn(part_c, F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col(part_c)), F.lit(0).cast("long")))
    else:
        dealt = dealt.withColumn(part_c, F.lit(0).cast("long"))
    return dealt.groupBy(block_c, part_c).cogroup(verdicts.groupBy("block", "part")).applyInArrow(drop, schema)


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
