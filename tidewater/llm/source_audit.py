"""Divergence of sources from each other and from their language, by the terms that they use.

A batch's texts are one buffer of UTF-8 bytes. A table of 256 entries tells which bytes belong to terms and lower-cases A-Z; where that changes, terms begin and end. Their
slices are grouped by xxhash, and every slice is compared with the first one of its hash byte by byte: slices that a hash joins wrongly are grouped by their
bytes. What leaves a batch is counted by language, source and term.

A term that enough documents of its language hold is kept. The kept counts are dealt into shards by a hash of (language, term), so that neither a large source
nor a frequent term makes a large shard; each shard also gets the list of sources. It builds a CSR matrix (sources by terms) for each language, and for each source the
divergences to all others as sums over their rows (reduceat): a term that a row lacks has a share of its own, so terms without an entry are added by the number of terms
for each share. The shards' sums are added up. Languages of many sources are dealt into tiles of sources.

All arithmetic is in whole numbers. A share is p = 1 + floor(SCALE * (count + 1) / (N + V)), a divergence floor((p - q) * (p - q) / q); shares are exact while N + V is below 2**53.

Cases: null text, lang and source are ''; a (lang, source) group without terms takes part with shares of terms that it lacks; a language without kept terms has divergences of 0
between its sources and no terms; a source alone in its language has no pairs; rows that repeat are documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import CHUNK_BYTES, shared_table

#: Documents of a language that must hold a term.
MIN_DOCS = 3
#: Ranks of terms that are told.
TOP = 200
SCALE = 1_000_000_000
#: Bytes of texts whose counts a task puts together before it tells them.
MERGED_BYTES = 8 << 20
#: Counts of a shard, about; shards at least; sources of a tile.
SHARD_COUNTS, SHARDS, TILE = 65_536, 24, 64

#: Byte -> itself lower-cased if it belongs to a term, else 0.
LOWER = np.zeros(256, np.uint8)
LOWER[0x80:] = np.arange(0x80, 0x100)
LOWER[0x41:0x5B] = LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)


def slices(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms of lower-cased bytes (0: none) begin and end."""
    inside = np.concatenate([[False], buffer != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def grouped(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """A number for each slice, the same for equal bytes only, and for each number the place of a slice that has it."""
    data = buffer.tobytes()
    hashes = np.fromiter(map(hashed, map(data.__getitem__, map(slice, starts.tolist(), ends.tolist()))), np.uint64, len(starts))
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    # every slice against the first one of its hash
    size = ends - starts
    model = first[number]
    equal = size == size[model]
    check = np.flatnonzero(equal & (model != np.arange(len(model))))
    n = size[check]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    same = buffer[np.repeat(starts[check], n) + within] == buffer[np.repeat(starts[model[check]], n) + within]
    if len(check):
        equal[check] = np.logical_and.reduceat(same, np.cumsum(n) - n)
    if not equal.all():
        own: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(~equal).tolist():
            term = data[starts[i] : ends[i]]
            if term not in own:
                own[term] = len(first) + len(own)
                more.append(i)
            number[i] = own[term]
        first = np.concatenate([first, np.array(more, first.dtype)])
    return number, first


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)


def counted(texts: Iterable[tuple[int, memoryview]]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts (group, UTF-8 bytes) the distinct terms, and for each group and term that meet: the group, the term's number, occurrences and documents.

    Texts are taken some at a time, as long as they are short together, and counts are told for about MERGED_BYTES of them.
    """
    numbers: dict[bytes, int] = {}
    found: list[tuple[np.ndarray, ...]] = []

    def told() -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sums = _summed(*(np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(4)))
        terms = list(numbers)
        numbers.clear()
        found.clear()
        return terms, *sums

    def take(held: list[tuple[int, memoryview]]) -> None:
        # a zero byte after each text parts it from the next
        buffer = LOWER[np.frombuffer(b"\0".join([*(t for _, t in held), b""]), np.uint8)]
        starts, ends = slices(buffer)
        if not len(starts):
            return
        number, first = grouped(buffer, starts, ends)
        data = buffer.tobytes()
        known = np.fromiter((numbers.setdefault(t, len(numbers)) for t in map(data.__getitem__, map(slice, starts[first].tolist(), ends[first].tolist()))), np.int64, len(first))
        doc = np.searchsorted(np.cumsum([len(t) + 1 for _, t in held]), starts, side="right")
        pair, n = np.unique(doc.astype(np.int64) * len(first) + number, return_counts=True)
        group = np.array([g for g, _ in held])[pair // len(first)]
        found.append(_summed(group, known[pair % len(first)], n, np.ones(len(n), np.int64)))

    held, size, whole = [], 0, 0
    for group, text in texts:
        held.append((group, text))
        size += len(text)
        if size >= CHUNK_BYTES:
            take(held)
            whole += size
            held, size = [], 0
            if whole >= MERGED_BYTES:
                yield told()
                whole = 0
    if held:
        take(held)
    yield told()


def _summed(group: np.ndarray, term: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences and documents summed for each group and term."""
    key = group << 40 | term
    order = np.argsort(key, kind="stable")
    begins = _runs(key[order])
    if not len(begins):
        return group, term, n, docs
    key = key[order][begins]
    return key >> 40, key & (1 << 40) - 1, np.add.reduceat(n[order], begins), np.add.reduceat(docs[order], begins)


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it) of documents (text, lang, source); each group also has a row without a term."""

    def told(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "term", "n", "docs"]
        for part in parts:
            if not part.num_rows:
                continue
            groups: dict[tuple[str, str], int] = {}
            of = [groups.setdefault(key, len(groups)) for key in zip(part["lang"].to_pylist(), part["source"].to_pylist(), strict=True)]
            langs, sources = (pa.array(x, pa.string()) for x in zip(*groups, strict=True))
            none = pa.array([0] * len(groups), pa.int64())
            yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(groups), pa.string()), none, none], names)
            texts = part["text"].cast(pa.large_binary())
            for terms, group, term, n, docs in counted((g, memoryview(x.as_buffer())) for g, x in zip(of, texts, strict=True)):
                group = pa.array(group)
                yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(term)), pa.array(n), pa.array(docs)], names)

    given = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    rows = given.mapInArrow(told, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total) in 64 bits, three digits of SCALE at a time."""
    rest, out = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        out, rest = out * 1000 + F.call_function("div", rest * 1000, total), rest * 1000 % total
    return out + 1


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same of arrays."""
    rest, out = count + 1, np.zeros(1, np.int64)
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // total, rest * 1000 % total
    return out + 1


def divergences(row: np.ndarray, term: np.ndarray, count: np.ndarray, total: np.ndarray, terms: int, wanted: np.ndarray) -> np.ndarray:
    """For each wanted source (a place in total) its divergences to all sources, summed over `terms` terms. row, term, count: entries, ascending by row; total: N + V of each source."""
    p, none = shares(count, total[row]), shares(np.zeros(len(total), np.int64), total)
    ends = np.searchsorted(row, np.arange(len(total) + 1))
    filled = np.flatnonzero(ends[1:] > ends[:-1])
    out = np.zeros((len(wanted), len(total)), np.int64)
    for i, g in enumerate(wanted.tolist()):
        own = np.full(terms, none[g])
        own[term[ends[g] : ends[g + 1]]] = p[ends[g] : ends[g + 1]]
        # as if no other source had any of the terms, by the distinct shares of this one
        values, n = np.unique(own, return_counts=True)
        apart = values[None, :] - none[:, None]
        out[i] = (apart * apart // none[:, None] * n[None, :]).sum(axis=1)
        # and what the entries of the others change
        if len(row):
            apart, before = own[term] - p, own[term] - none[row]
            out[i, filled] += np.add.reduceat(apart * apart // p - before * before // none[row], ends[filled])
    return out


def _shard(part: pa.Table) -> pa.Table:
    """Sums of a shard's divergences. Rows without a term list all sources of a language; `mine` are those of the tile."""
    part = part.sort_by([("lang", "ascending"), ("source", "ascending")]).combine_chunks()
    names = ["lang", "source", "item", "value"]
    made = []
    lang = np.unique(part["lang"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
    begins = _runs(lang)
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(lang)], strict=True):
        here = part.slice(a, b - a)
        listed = here.filter(pa.compute.is_null(here["term"]))
        entries = here.filter(pa.compute.is_valid(here["term"]))
        if not entries.num_rows:
            continue
        sources = listed["source"].combine_chunks()
        row = pa.compute.index_in(entries["source"], value_set=sources).to_numpy()
        terms, term = np.unique(entries["term"].to_numpy(zero_copy_only=False), return_inverse=True)
        wanted = np.flatnonzero(listed["mine"].to_numpy(zero_copy_only=False))
        sums = divergences(row, term, entries["n"].to_numpy(), listed["total"].to_numpy(), len(terms), wanted)
        g, h = np.nonzero(wanted[:, None] != np.arange(len(sources))[None, :])
        made.append(pa.table([pa.array([here["lang"][0].as_py()] * len(g), pa.string()), sources.take(pa.array(wanted[g])), sources.take(pa.array(h)), pa.array(sums[g, h])], names))
    return pa.concat_tables(made) if made else pa.table({c: pa.array([], pa.int64() if c == "value" else pa.string()) for c in names})


def audit(documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: each source of documents (text, lang, source) against the others of its language (part `pair`), and the terms in
    which it exceeds its language (part `term`, ranks up to `top`)."""
    counts = shared_table(term_counts(documents), "counts")
    by_term = W.partitionBy("lang", "term")
    # one row of each term is its head
    weighed = counts.where(F.col("term").isNotNull()).select("lang", "source", "term", "n", F.sum("docs").over(by_term).alias("docs"), F.sum("n").over(by_term).alias("all"), (F.row_number().over(by_term.orderBy("source")) == 1).cast("long").alias("head"))
    kept = shared_table(weighed.where(F.col("docs") >= min_docs).drop("docs"), "kept")
    by_lang = kept.groupBy("lang").agg(F.sum("head").alias("v"), F.sum("n").alias("lang_n"))
    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    named = counts.where(F.col("term").isNull()).select("lang", "source").join(of_source, ["lang", "source"], "left").join(by_lang, "lang", "left")
    several = named.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("own_n", "v", "lang_n"))).withColumn("tiles", F.ceil(F.count("*").over(W.partitionBy("lang")) / TILE).cast("int"))
    groups = shared_table(several.withColumn("total", F.col("own_n") + F.col("v")), "groups")
    shards = max(SHARDS, kept.count() // SHARD_COUNTS)

    met = kept.join(groups, ["lang", "source"])
    dealt = met.select(F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard"), "tiles", "lang", "source", "term", "n", "total")
    listed = groups.where("v > 0").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "tiles", "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "total")
    tiled = dealt.unionByName(listed).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("mine", F.pmod(F.xxhash64("source"), F.col("tiles")) == F.col("tile")).drop("tiles")
    sums = tiled.groupBy("shard", "tile").applyInArrow(_shard, "lang string, source string, item string, value long")
    others = groups.select("lang", F.col("source").alias("item"))
    zero = groups.select("lang", "source").join(others, "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = sums.unionByName(zero).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    p, q = share(F.col("n"), F.col("total")), share(F.col("all"), F.col("lang_n") + F.col("v"))
    above = met.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", "rank"]
    return pairs.withColumn("rank", rank).select(*columns("pair")).unionByName(above.withColumn("rank", rank).where(F.col("rank") <= top).select(*columns("term")))
