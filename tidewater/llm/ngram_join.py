"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct word shingles; equal sets are one node. In the order of the shingles' hashes a node is indexed by a prefix that
is so long that a similar one shares k of it (the smaller k of the two): n - ceil(t n) + k of n shingles. k grows
with the size (`_needed`), so that a rare phrase or two that long texts share do not chain them. The index entries are counted by an ordinary grouping.
 - Entries of fewer than 2**FREQUENT nodes bring candidates together: pairs of nodes that share as many as needed.
 - Shingles that are entries of more nodes are frequent, and their nodes are indexed anew in the order (frequent or not, hash): the prefix is extended to
   as many other shingles, which are counted again, and so on. Where a node has too few that are rare, frequent ones follow, which fall into small groups that both
   documents form alike (by hash, for the size class of the larger one). A group of g is indexed by its pairs and accounts for g - 1 missing shingles. One pair makes candidates.
   After ROUNDS of this all shingles of the nodes that are left are counted, which leaves no entry of a single shingle that is frequent.
Two similar nodes share a pair or k single shingles in each round in which both take part. If it is a pair or all of the k are rare, they are candidates; if not, both are in the next round.

Entries are dealt by value into slices. A block of nodes tells a slice its entries once, packed; the slice counts them, and answers with links and with what is frequent.
A block tells by itself what is frequent within it, and of nodes of one size class that share a pair only the first, so that a slice has a few rows at most for each block and entry.

What shares an entry and has a fitting size is a candidate. Candidates chain into clusters, and each cluster's nodes are compared with
each other, tile by tile where it is large: exact intersections of whole sets from products of incidence blocks. A tile gives back a spanning
forest of its links, never all its pairs.

Cases: a null or empty text (or one of white space only) has an empty set and links with nothing; fewer words than the shingle's
are one shingle; rows with equal sets belong together; rows without doc_id get no component; rows that share a doc_id are
judged by their own texts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import CHUNK_ROWS, binary, chunks, hashed_words, mix, partitions, release, releasing, shared_table
from tidewater.llm.components import components, spanning

WORDS = 5
#: Percent: two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Shingles that 2**FREQUENT nodes or more hold are indexed by pairs. Few, so that a passage that unrelated documents share does not make them candidates.
FREQUENT = 2
#: Mean size of a group of frequent shingles.
GROUP = 4
#: Nodes of a tile's side and their shingles, about; smaller clusters are compared several to a task, of about LUMP shingles. Shingles of an incidence block.
TILE, TILE_SHINGLES, LUMP, COLUMNS = 256, 1_000_000, 100_000, 4_096
#: Of the shingles that a node may lack, one in so many is indexed and needed beyond the first.
SPARE = 16
#: What a link counts that needs no other.
SURE = 1 << 40
#: Entries of a slice, about, and slices where there are fewer entries (or as many as Spark has shuffle partitions).
SLICE_ENTRIES, SLICES = 1_000_000, 200
#: Rounds of indexing in which only entries are counted.
ROUNDS = 3
#: A shingle's bits: entries of single shingles are its hash, those of pairs are negative.
BITS = 48
#: Node numbers up to which a side of a semi-join is broadcast, and frequent shingles (8 bytes each) up to which they are; beyond, joins shuffle.
BROADCAST_ROWS, BROADCAST_SHINGLES = 2_000_000, 16_000_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _shingle_sets(texts: list[bytes | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    for a, b in chunks(texts):
        flat, n = hashed_words(texts[a:b])
        at = 0
        if len(flat) >= words:
            whole = sum((flat[i : len(flat) - words + 1 + i] * _MULTIPLIERS[i] for i in range(words)), np.uint64(0))
            whole = mix(whole)
        for m in n.tolist():
            if m >= words:
                yield np.unique(whole[at : at + m - words + 1])
            elif m:
                short = flat[at : at + m]
                yield mix((short * _MULTIPLIERS[:m]).sum(dtype=np.uint64, keepdims=True) + np.uint64(m))
            else:
                yield np.zeros(0, np.uint64)
            at += m


def _pack(values: np.ndarray) -> bytes:
    """Ascending numbers of BITS: differences, byte plane by byte plane, compressed."""
    steps = np.diff(values, prepend=values[:1] * 0)
    return zstandard.ZstdCompressor(level=1).compress(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8].T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(BITS // 8, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : BITS // 8] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _missing(n: int) -> int:
    """Shingles of n that a similar set may lack."""
    return n - -(-PERCENT * n // 100)


def _size_class(n: int) -> int:
    return int(np.floor(np.log(n) / np.log(100 / PERCENT) + 1e-9))


def _needed(kind: np.ndarray) -> np.ndarray:
    """Rare entries that a node of a size class shares with any similar one that has as large a size class or a larger one."""
    return 1 + np.floor((100 / PERCENT) ** kind * (100 - PERCENT) / 100 / SPARE).astype(np.int64)


def _prefix(n: int) -> int:
    """Shingles of n that are indexed where none is frequent."""
    return _missing(n) + int(_needed(np.array(_size_class(n))))


def _entries(held: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Index entries of an ascending set of shingle hashes, with what is frequent marked."""
    n = len(held)
    rare, rest = held[~frequent], held[frequent]
    found = [rare[: _prefix(n)]]
    short = _prefix(n) - len(rare)
    if short > 0:
        for z in {_size_class(n), _size_class(n) + 1}:
            groups = int((100 / PERCENT) ** z / GROUP) + 1
            of = (mix(rest + np.uint64(z)) % np.uint64(groups)).astype(np.int64)
            order = np.lexsort((rest, of))
            values, of = rest[order], of[order]
            begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
            sizes = np.diff(np.r_[begins, len(of)])
            last = int(np.searchsorted(np.cumsum(sizes - 1), short)) + 1
            for a, m in zip(begins[:last], sizes[:last], strict=True):
                i, j = np.triu_indices(m, 1)
                found.append(mix(values[a : a + m][i] * _MULTIPLIERS[0] + values[a : a + m][j] * _MULTIPLIERS[1] + np.uint64(z)) | np.uint64(1 << 63))
    return np.unique(np.concatenate(found))


def shingled(documents: DataFrame) -> DataFrame:
    """row (unique), doc_id, n, hash (of the set) and held (the set's hashes of BITS, ascending, packed) for each row; written."""

    @releasing
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                texts = binary(batch["text"].slice(at, CHUNK_ROWS))
                for a, b in chunks(texts):
                    sets = list(_shingle_sets(texts[a:b]))
                    yield pa.RecordBatch.from_arrays([
                        batch["doc_id"].slice(at + a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([_pack(s >> np.uint64(64 - BITS)) for s in sets], pa.binary()),
                    ], ["doc_id", "n", "hash", "held"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    sets = documents.select("doc_id", "text").mapInArrow(made, f"doc_id {id_type}, n long, hash binary, held binary")
    return shared_table(sets.select(F.monotonically_increasing_id().alias("row"), "*"), "sets")


def _with(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows (row, ...) of the nodes that are wanted (node), as node."""
    few = wanted.count() <= BROADCAST_ROWS
    return rows.withColumnRenamed("row", "node").join(F.broadcast(wanted) if few else wanted, "node", "left_semi")


def _shrunk(values: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _grown(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def _steps(values: np.ndarray) -> bytes:
    """Ascending whole numbers, as differences."""
    return _shrunk(np.diff(values, prepend=values[:1] * 0))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _cut(values: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of values by slice, and where slices begin and end in it."""
    of = values % slices
    order = np.argsort(of.astype(np.uint16) if slices < 1 << 16 else of, kind="stable")  # short numbers sort by radix
    return order, np.searchsorted(of[order], np.arange(slices + 1))


def _told(node: np.ndarray, n: np.ndarray, made: list[np.ndarray], slices: int) -> pa.RecordBatch:
    """What a block of nodes with their sizes and entries tells the slices (q)."""
    flat, place = np.concatenate([np.zeros(0, np.uint64), *made]), np.repeat(np.arange(len(made)), [len(x) for x in made])
    kind = np.floor(np.log(n) / np.log(100 / PERCENT) + 1e-9).astype(np.int64)
    paired = flat >= 1 << 63
    one, at = flat[~paired].astype(np.int64), place[~paired]
    order = np.argsort(one, kind="stable")
    one, at = one[order], at[order]
    begins = np.flatnonzero(_starts(one))
    c = np.diff(begins, append=len(one))
    many = np.repeat(c >= 1 << FREQUENT, c)
    hot, active, one, at = one[begins][c >= 1 << FREQUENT], node[np.unique(at[many])], one[~many], at[~many]
    # BITS of a pair are enough: what collides is a candidate without need
    two, by = (flat[paired] << np.uint64(1) >> np.uint64(64 - BITS)).astype(np.int64), place[paired]
    order = np.lexsort((node[by], kind[by], two))
    two, by = two[order], by[order]
    first = _starts(two, kind[by])
    lead = by[first][np.cumsum(first) - 1]
    links = np.unique(np.stack([node[by[~first]], node[lead[~first]]]), axis=1)
    two, by = two[first], by[first]

    rows, own = [], int(node[0]) % slices if len(node) else 0
    (o, cut), (o2, cut2), (o3, cut3) = _cut(one, slices), _cut(two, slices), _cut(hot, slices)
    one, at, two, by, hot = one[o] // slices, at[o], two[o2] // slices, by[o2], hot[o3] // slices
    for q in range(slices):
        i, j, k = slice(cut[q], cut[q + 1]), slice(cut2[q], cut2[q + 1]), slice(cut3[q], cut3[q + 1])
        mine = q == own and (len(active) or links.size)
        if mine or i.start < i.stop or j.start < j.stop or k.start < k.stop:
            used, which = np.unique(np.concatenate([at[i], by[j]]), return_inverse=True)
            rows.append((q, [_steps(one[i]), _steps(two[j]), _shrunk(which), _steps(node[used]), _shrunk(kind[used]), _steps(hot[k]), *(map(_shrunk, (active, *links)) if mine else [])]))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.binary()))], ["q", "told"])


def _shared(entry: np.ndarray, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Pairs of nodes of fitting size classes, how many entries they share, and how many they need: (4, n). Entries of few nodes."""
    order = np.lexsort((node, entry))
    entry, node, kind = entry[order], node[order], kind[order]
    found = []
    for d in range(1, 1 << FREQUENT):
        i = np.flatnonzero((entry[d:] == entry[:-d]) & (np.abs(kind[d:] - kind[:-d]) <= 1))
        found.append(np.stack([node[i + d], node[i], np.minimum(kind[i + d], kind[i])]))
    pairs = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
    pairs = pairs[:, np.lexsort(pairs)]
    begins = np.flatnonzero(_starts(*pairs[:2]))
    a, b, kind = pairs[:, begins]
    return np.stack([a, b, np.diff(begins, append=pairs.shape[1]), _needed(kind)])


def _linked(entry: np.ndarray, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Links (2, n) of each node of an entry to the smallest one of a fitting size. A node stands at its size class and the next one; similar ones are at most one class apart, so they meet."""
    order = np.argsort(entry, kind="stable")
    begins = np.flatnonzero(_starts(entry[order]))
    c = np.diff(begins, append=len(entry))
    order = order[np.repeat(c > 1, c)]
    entry, node, kind = np.tile(entry[order], 2), np.tile(node[order], 2), np.concatenate([kind[order], kind[order] + 1])
    order = np.lexsort((node, kind, entry))
    entry, node, kind = entry[order], node[order], kind[order]
    first = _starts(entry, kind)
    return np.stack([node, node[first][np.cumsum(first) - 1]])[:, ~first]


def _answered(part: pa.Table, slices: int) -> pa.Table:
    """A slice's links (kind 0: a, b, the entries c they share and those they need), frequent shingles (kind 1: a) and the nodes that have these (kind 2: a)."""
    q, parts = part["q"][0].as_py(), [list(map(_grown, x)) for x in part["told"].to_pylist()]
    values = lambda k: [np.cumsum(x[k]) * slices + q for x in parts]
    nodes = [np.cumsum(x[3])[x[2]] for x in parts]
    kinds = [x[4][x[2]] for x in parts]
    ones = [len(x[0]) for x in parts]
    early = lambda columns: np.concatenate([x[:k] for x, k in zip(columns, ones, strict=True)])
    late = lambda columns: np.concatenate([x[k:] for x, k in zip(columns, ones, strict=True)])
    one, node, kind = np.concatenate(values(0)), early(nodes), early(kinds)
    found, which, c = np.unique(one, return_inverse=True, return_counts=True)
    told = np.unique(np.concatenate(values(5)))
    often = (c >= 1 << FREQUENT) | np.isin(found, told)
    hot = often[which]
    active = np.unique(np.concatenate([node[hot], *(x[6] for x in parts if len(x) > 6)]))
    fresh = np.union1d(found[often], told)
    some = _shared(one[~hot], node[~hot], kind[~hot])
    sure = np.concatenate([_linked(np.concatenate(values(1)), late(nodes), late(kinds)), *(np.stack(x[7:9]) for x in parts if len(x) > 6)], axis=1)
    sure = sure[:, np.lexsort(sure)]
    sure = sure[:, _starts(*sure)]
    links = np.concatenate([some, np.stack([*sure, np.full(sure.shape[1], SURE), np.zeros(sure.shape[1], np.int64)])], axis=1)
    n = [links.shape[1], len(fresh), len(active)]
    links = np.pad(links, ((0, 0), (0, n[1] + n[2])))
    return pa.table({"kind": np.repeat(np.arange(3, dtype=np.int32), n), "a": np.concatenate([links[0, : n[0]], fresh, active]), "b": links[1], "c": links[2], "need": links[3]})


def _met(told: DataFrame, slices: int) -> DataFrame:
    """kind, a, b, c, need from what blocks tell; written."""

    def answer(part: pa.Table) -> pa.Table:
        found = _answered(part, slices)
        release()
        return found

    return shared_table(told.groupBy("q").applyInArrow(answer, "kind int, a long, b long, c long, need long"), "met")


def _enough(met: DataFrame) -> DataFrame:
    """a, b: the links of a round that share as many entries as they need, over all slices."""
    links = met.where("kind = 0").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "c", "need")
    return links.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("need").alias("need")).where("c >= need").select("a", "b")


def _tokens(sets: DataFrame) -> DataFrame:
    """node, shingle for every shingle of sets (node, held)."""

    @releasing
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = _unpack(batch["held"][i].as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), batch["node"][i].as_py())), pa.array(held)], ["node", "shingle"])

    return sets.select("node", "held").mapInArrow(told, "node long, shingle long")


def _counted(sets: DataFrame) -> DataFrame:
    """shingle, c of sets (held); counted within batches first."""

    @releasing
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = np.concatenate([np.zeros(0, np.int64), *(_unpack(x).view(np.int64) for x in batch["held"].to_pylist())])
            shingles.sort()
            begins = np.flatnonzero(np.diff(shingles, prepend=-1))  # no shingle is negative
            yield pa.RecordBatch.from_arrays([pa.array(shingles[begins]), pa.array(np.diff(begins, append=len(shingles)))], ["shingle", "c"])

    return sets.select("held").mapInArrow(summed, "shingle long, c long").groupBy("shingle").agg(F.sum("c").alias("c"))


def _remains(held: np.ndarray, since: np.ndarray, rounds: int) -> bool:
    """Whether a node had frequent entries in each of the rounds so far; since: the round that found a shingle frequent, or more than these."""
    return all((since[since >= r][: _prefix(len(held))] == r).any() for r in range(rounds))


def _entered(sets: DataFrame, often: np.ndarray, slices: int, since: np.ndarray | None = None) -> DataFrame:
    """q, told of the entries of sets (node, n, held), with these shingles as the frequent ones. since: the round that found each, where the nodes that remain are to be told from these."""
    rounds = 0 if since is None else int(since.max(initial=-1)) + 1
    sent = sets.sparkSession.sparkContext.broadcast((often, since))  # at most BROADCAST_SHINGLES

    @releasing
    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, since = sent.value
        for batch in batches:
            made, taken = [], []
            for i, x in enumerate(batch["held"]):
                held = _unpack(x.as_py())
                at = np.minimum(np.searchsorted(often, held), max(0, len(often) - 1))
                known = often[at] == held if len(often) else np.zeros(len(held), bool)
                if not rounds or _remains(held, np.where(known, since[at], rounds), rounds):
                    made.append(_entries(held, known))
                    taken.append(i)
            yield _told(batch["node"].to_numpy()[taken], batch["n"].to_numpy()[taken], made, slices)

    return sets.mapInArrow(entered, "q int, told array<binary>")


def _entered_by_join(sets: DataFrame, often: DataFrame, slices: int) -> DataFrame:
    """The same where too many shingles are frequent to be sent."""
    marked = _tokens(sets).join(often.withColumn("often", F.lit(True)), "shingle", "left")
    by = marked.groupBy("node").agg(F.collect_list(F.struct("shingle", F.coalesce("often", F.lit(False)).alias("often"))).alias("held"))

    @releasing
    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for x in batch["held"]:
                held, often = (x.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                order = np.argsort(held)
                made.append(_entries(held.view(np.uint64)[order], often[order]))
            yield _told(batch["node"].to_numpy(), np.array([len(x) for x in batch["held"]]), made, slices)

    return by.mapInArrow(entered, "q int, told array<binary>")


def _numbers(shingles: DataFrame) -> np.ndarray:
    return np.sort(shingles.toPandas()["shingle"].to_numpy(np.int64).view(np.uint64))


def candidates(sets: DataFrame) -> DataFrame:
    """a, b: links that bring the rows of sets (row, n, held) together, all of them nodes. Between nodes whose sizes rule a link out there is none."""
    entries = (sets.agg(F.sum("n")).first()[0] or 0) * (100 - PERCENT) // 100
    slices = max(min(SLICES, partitions(sets.sparkSession)), entries // SLICE_ENTRIES)
    sets = sets.select("row", "n", "held")
    every, active, found = sets.withColumnRenamed("row", "node"), None, []
    often, since = np.zeros(0, np.uint64), np.zeros(0, np.int8)
    for k in range(ROUNDS):
        if active is None:
            told = _entered(every, often, slices)
        elif active.count() <= BROADCAST_ROWS:
            told = _entered(_with(sets, active), often, slices)
        else:  # a node tells from its set and what was found frequent when; a join would shuffle the sets
            told = _entered(every, often, slices, since)
        met = _met(told, slices)
        found.append(_enough(met))
        fresh = met.where("kind = 1").select(F.col("a").alias("shingle"))
        new = fresh.count()
        if not new:
            break
        active = shared_table(met.where("kind = 2").select(F.col("a").alias("node")).distinct(), "active")
        if len(often) + new > BROADCAST_SHINGLES:
            often = None
            break
        often, since = np.concatenate([often, _numbers(fresh)]), np.concatenate([since, np.full(new, k, np.int8)])
        order = np.argsort(often)
        often, since = often[order], since[order]
    if often is None or new:
        whole = _with(sets, active)
        frequent = shared_table(_counted(whole).where(F.col("c") >= 1 << FREQUENT).select("shingle"), "frequent")
        few = frequent.count() <= BROADCAST_SHINGLES
        found.append(_enough(_met(_entered(whole, _numbers(frequent), slices) if few else _entered_by_join(whole, frequent, slices), slices)))
    links = found[0]
    for x in found[1:]:
        links = links.unionByName(x)
    return links


def _similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (one of left, one of right) whose sets are similar, by exact intersections."""
    size = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values = values[order]
    follows = values[1:] == values[:-1]
    common = np.zeros(len(values), bool)  # those that two sets hold
    common[1:] |= follows
    common[:-1] |= follows
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)[order[common]]
    begins = ~np.concatenate([[False], follows])[common]
    del values, order, follows, common
    column = np.cumsum(begins, dtype=np.int32) - 1  # ascending
    both = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2**24 are exact
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [a, a + COLUMNS])
        grid = np.zeros((len(sets), COLUMNS), np.float32)
        grid[owner[i:j], column[i:j] - a] = 1
        both += grid[left] @ grid[right].T
    union = size[left][:, None] + size[right][None, :] - both.astype(np.int64)
    i, j = np.nonzero(100 * both.astype(np.int64) >= PERCENT * union)
    return left[i], right[j]


def _links(sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """a, b: spanning links of the similar pairs within clusters (node, component). Each node meets each part of its cluster once."""
    clusters = shared_table(clusters, "clusters")
    few = clusters.count() <= BROADCAST_ROWS
    sent = F.broadcast if few else lambda x: x
    sized = sets.select(F.col("row").alias("node"), "n").join(sent(clusters), "node").groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    sized = shared_table(sized.withColumn("parts", F.ceil(F.greatest(F.col("m") / TILE, F.col("n") / TILE_SHINGLES)).cast("int")), "sized")
    lumps = max(1, (sized.agg(F.sum("n")).first()[0] or 0) // LUMP)
    dealt = shared_table(clusters.join(sized, "component").select("node", F.col("component").alias("cluster"), "parts"), "dealt")
    met = sets.select(F.col("row").alias("node"), "held").join(sent(dealt), "node").select(
        "node", "held", "cluster", "parts",
        F.pmod(F.xxhash64(F.lit(17), "node"), F.col("parts")).cast("int").alias("part"),
        F.when(F.col("parts") == 1, F.pmod(F.xxhash64("cluster"), F.lit(lumps))).otherwise(-1).alias("lump"), F.when(F.col("parts") > 1, F.col("cluster")).alias("own"),
    )
    tiles = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("lump", "own", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "cluster", "node", "held")

    def compared(part: pa.Table) -> pa.Table:
        part = part.sort_by("cluster").combine_chunks()
        nodes, sets = part["node"], [_unpack(x) for x in part["held"].to_pylist()]
        cluster, side = part["cluster"].to_numpy(), part["part"].to_numpy()
        p, q = part["p"][0].as_py(), part["q"][0].as_py()
        found: list[np.ndarray] = []
        begins = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]])
        for a, b in zip(begins, [*begins[1:], len(cluster)], strict=True):
            if b - a > 1:
                here = side[a:b]
                left, right = (np.arange(b - a),) * 2 if p == q else (np.flatnonzero(here == p), np.flatnonzero(here == q))
                if len(left) and len(right):
                    i, j = _similar(sets[a:b], left, right)
                    i, j = (i[i < j], j[i < j]) if p == q else (i, j)
                    keep = spanning(b - a, i, j)
                    found.append(np.stack([i[keep] + a, j[keep] + a]))
        i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), int)
        return pa.table({"a": nodes.take(pa.array(i, pa.int64())), "b": nodes.take(pa.array(j, pa.int64()))})

    def compare(part: pa.Table) -> pa.Table:
        found = compared(part)
        release()
        return found

    return tiles.groupBy("lump", "own", "p", "q").applyInArrow(compare, "a long, b long")


def similar_groups(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of documents (doc_id, text)."""
    sets = shingled(documents)
    known = sets.where(F.col("hash").isNotNull() & F.col("doc_id").isNotNull())
    # a node is the first row of those with a set
    nodes = shared_table(known.groupBy("hash").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "reps")
    several = nodes.where("rows > 1").select("hash", "node")
    # the other rows are named rather than the nodes, as they are fewer in most tables
    repeats = shared_table(known.select("row", "hash").join(F.broadcast(several) if several.count() <= BROADCAST_ROWS else several, "hash").where("row <> node").select("row"), "repeats")
    few = repeats.count() <= BROADCAST_ROWS
    sets_of_nodes = known.select("row", "n", "held").join(F.broadcast(repeats) if few else repeats, "row", "left_anti")
    if not few:
        sets_of_nodes = shared_table(sets_of_nodes, "nodes")  # else each round would shuffle the sets
    part = components(_links(sets_of_nodes, components(candidates(sets_of_nodes))))

    named = nodes.join(part, "node", "left").select("hash", "rep", F.coalesce("component", "node").alias("component"))
    named = shared_table(named, "named")
    least = shared_table(named.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    whole = shared_table(named.join(least, "component").select("hash", "component_id"), "whole")
    every = known.select("doc_id", "n", "hash").join(whole, "hash").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sets.where(F.col("hash").isNull() | F.col("doc_id").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return every.union(alone)
