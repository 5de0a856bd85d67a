"""Embedding near-dedup with randomised-rotation binary codes.

Unit vectors are rotated by a random orthogonal matrix of a fixed seed; the signs are a vector's code o', packed to bits, and its
correction factor <o', o> is stored with it. For another vector q, <o', q> / <o', o> estimates <o, q> without bias; if the cosine
is the threshold t, the estimate differs from it by sqrt(1 - t^2) * sqrt(1 - <o', o>^2) / <o', o> times a factor that exceeds
min(1, EPSILON / sqrt(D - 1)) with negligible probability. The rotated q is stored in bytes, rounded at random so that it stays unbiased, and the bound takes
the largest rounding error in. Pairs whose estimate lies below t by more than that bound are settled by the codes alone; vectors are fetched only for rows of the
other pairs, which are computed exactly, in double precision.

Candidates share a band of signs of further rotations. A band's bits grow with the logarithm of the largest label's size, so that a bucket of unrelated vectors holds
about one, and the number of bands is such that a pair at exactly the threshold shares none with probability MISSED at every size. A bucket of any
size is dealt into tiles of bounded size, compared one by one; a pair counts in the first band that it shares. A tile gives back each vector's number of
links and a spanning forest of them, never all its pairs. Nodes are distinct vectors of a label, whatever vec_ids they have.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and keep themselves, as do those without a label;
equal vectors of a label (by 128 bits of hash) are compared once; vectors of different lengths do not link; rows that share a vec_id are judged by their own vectors;
rows without vec_id take no part and get no component; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import shared_table
from tidewater.llm.components import components, spanning

THRESHOLD = 0.98
SEED = 20_240_521
#: Probability that a pair at the threshold shares no band; fewest bits of a band.
MISSED, LEAST_BITS = 3e-6, 8
EPSILON = 6.0
#: Rows of a tile's side; buckets of fewer rows are compared several to a tile, of about CHUNK rows.
TILE, CHUNK = 512, 2_048
#: Pairs of small buckets that are estimated at once.
PAIRS = 20_000


@functools.lru_cache(maxsize=16)
def rotation(dimension: int, columns: int, seed: int = SEED) -> np.ndarray:
    """(dimension, columns): orthogonal matrices side by side, the last one cut."""
    draw, found = np.random.default_rng([seed, dimension]), []
    while sum(m.shape[1] for m in found) < columns:
        q, r = np.linalg.qr(draw.standard_normal((dimension, dimension)))
        found.append(q * np.sign(np.diag(r)))
    return np.concatenate(found, axis=1)[:, :columns]


def layout(rows: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bands and bits of a band where the largest label has so many distinct vectors."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, rows))))
    shared = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(MISSED) / math.log1p(-shared)), bits


def units(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(1, keepdims=True)  # very large and very small vectors have a norm too
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: signs (n, dimension), correction factors, rotated components in bytes (n, dimension) and what a byte's unit stands for."""
    n, dimension = vectors.shape
    turned = vectors @ rotation(dimension, dimension)
    unit = np.maximum(np.abs(turned).max(1), 1e-300) / 126
    low = np.floor(turned / unit[:, None])
    up = np.random.default_rng(SEED).random(turned.shape) < turned / unit[:, None] - low
    return turned > 0, np.abs(turned).sum(1) / np.sqrt(dimension), (low + up).astype(np.int8), unit


def bands_of(vectors: np.ndarray, bands: int, bits: int) -> np.ndarray:
    """(n, bands) numbers of that many bits, from rotations other than the code's."""
    dimension = vectors.shape[1]
    signs = vectors @ rotation(dimension, dimension + bands * bits)[:, dimension:] > 0
    return signs.reshape(len(vectors), bands, bits) @ (1 << np.arange(bits, dtype=np.int64))


def least_estimate(factor: np.ndarray, unit: np.ndarray, dimension: int, threshold: float) -> np.ndarray:
    """The estimate below which a pair can't reach the threshold; factor of the one side, unit of the other."""
    spread = np.sqrt(1 - threshold**2) * np.sqrt(np.maximum(0, 1 - factor**2))
    bound = spread * (min(1.0, EPSILON / np.sqrt(dimension - 1)) if dimension > 1 else 1.0) + unit * np.sqrt(dimension)
    return threshold - bound / factor - 1e-6  # the last for single precision


class Codes:
    """Rows of a tile, without their vectors."""

    def __init__(self, part: pa.Table, size: int, threshold: float) -> None:
        packed = np.frombuffer(b"".join(part["code"].to_pylist()), np.uint8).reshape(part.num_rows, -1)
        self.sides = np.where(np.unpackbits(packed, axis=1)[:, :size], np.float32(1), np.float32(-1)) / np.float32(np.sqrt(size))
        self.unit, self.factor = part["unit"].to_numpy(), part["factor"].to_numpy()
        self.turned = np.frombuffer(b"".join(part["bytes"].to_pylist()), np.int8).reshape(part.num_rows, size) * self.unit[:, None].astype(np.float32)
        self.size, self.threshold = size, threshold

    def block(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the rows of left with those of right that the codes leave open."""
        estimate = self.sides[left] @ self.turned[right].T / self.factor[left, None]
        i, j = np.nonzero(estimate >= least_estimate(self.factor[left, None], self.unit[None, right], self.size, self.threshold))
        return left[i], right[j]

    def pairs(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs (i, j) those that the codes leave open."""
        open_ = [np.zeros(0, bool)]
        for a in range(0, len(i), PAIRS):
            p, q = i[a : a + PAIRS], j[a : a + PAIRS]
            estimate = np.einsum("ij,ij->i", self.sides[p], self.turned[q]) / self.factor[p]
            open_.append(estimate >= least_estimate(self.factor[p], self.unit[q], self.size, self.threshold))
        keep = np.concatenate(open_)
        return i[keep], j[keep]


def _inside(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places in the same small bucket."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], bucket[order], side="right")
    rest = ends - np.arange(len(order)) - 1
    i = np.repeat(np.arange(len(order)), rest)
    j = np.arange(rest.sum()) - np.repeat(np.cumsum(rest) - rest, rest) + i + 1
    return order[i], order[j]


def _sides(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two sides of a tile of a large bucket."""
    side, p, q = part["part"].to_numpy(), part["p"][0].as_py(), part["q"][0].as_py()
    return np.flatnonzero(side == p), np.flatnonzero(side == q)


TILE_KEYS = ["label", "size", "band", "chunk", "p", "q"]


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings (vec_id, embedding, label)."""
    rows = embeddings.select("vec_id", F.col("embedding").alias("v"), F.col("embedding").cast("array<double>").alias("d"), "label")
    finite = F.forall("d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("d", lambda x: x != 0)
    fit = rows.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & some, F.lit(False)))
    key = ["label", "size", "h", "g"]
    used = fit.where("ok").select("vec_id", "v", "label", F.size("d").alias("size"), F.xxhash64("d").alias("h"), F.xxhash64(F.lit(1), "d").alias("g"))
    # equal vectors of a label are one node
    same = used.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    same = shared_table(same.withColumn("node", F.monotonically_increasing_id()), "vectors")
    held = same.groupBy("label", "size").agg(F.count("*").alias("held"))
    bands, bits = layout(held.agg(F.max("held")).first()[0] or 0, threshold)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["size"].to_numpy()
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x = units(part["v"].flatten().to_numpy().astype(float).reshape(-1, size))
                signs, factor, turned, unit = codes(x)
                buckets = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * bands, pa.int32()), pa.array(bands_of(x, bands, bits).ravel()))
                packed = [r.tobytes() for r in np.packbits(signs, axis=1)]
                yield pa.RecordBatch.from_arrays([part["label"], part["size"], part["node"], pa.array(packed, pa.binary()), pa.array(factor), pa.array([r.tobytes() for r in turned], pa.binary()), pa.array(unit), buckets], ["label", "size", "node", "code", "factor", "bytes", "unit", "bands"])

    label = same.schema["label"].dataType.simpleString()
    codes_ = shared_table(same.select("label", "size", "node", "v").mapInArrow(coded, f"label {label}, size int, node long, code binary, factor double, bytes binary, unit double, bands array<long>"), "codes")

    bucket = ["label", "size", "band", "bucket"]
    spread = codes_.select("label", "size", F.posexplode("bands").alias("band", "bucket"))
    # a bucket of m rows has ceil(m / TILE) parts; each row meets each part of its bucket in one tile
    filled = spread.groupBy(*bucket).agg(F.count("*").alias("m")).where("m > 1").join(held, ["label", "size"]).withColumn("parts", F.ceil(F.col("m") / TILE).cast("int"))
    small = F.pmod(F.xxhash64("bucket"), F.ceil(F.col("held") / CHUNK)).cast("long")
    filled = shared_table(filled.select(*bucket, "parts", F.when(F.col("parts") == 1, small).otherwise(-1 - F.col("bucket")).alias("chunk")), "buckets")
    full = codes_.select("label", "size", "node", "code", "factor", "bytes", "unit", F.posexplode("bands").alias("band", "bucket")).join(filled, bucket)
    dealt = full.withColumn("part", F.pmod(F.xxhash64(F.lit(17), "node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = dealt.select("label", "size", "band", "chunk", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "bucket", "part", "node", "code", "factor", "bytes", "unit")
    names = [*TILE_KEYS, "bucket", "part", "node"]

    def estimate(part: pa.Table) -> pa.Table:
        """The rows of a tile that have a pair which the codes leave open."""
        if part.num_rows < 2:
            return part.select(names).slice(0, 0)
        part = part.combine_chunks()
        tile = Codes(part, part["size"][0].as_py(), threshold)
        if part["chunk"][0].as_py() >= 0:
            i, j = tile.pairs(*_inside(part["bucket"].to_numpy()))
        else:
            left, right = _sides(part)
            i, j = tile.block(left, right)
            i, j = i[i != j], j[i != j]
        return part.select(names).take(pa.array(np.union1d(i, j), pa.int64()))

    open_ = tiles.groupBy(*TILE_KEYS).applyInArrow(estimate, f"label {label}, size int, band int, chunk long, p int, q int, bucket long, part int, node long")
    fetched = shared_table(open_, "open").join(same.select("node", "copies", "v"), "node").join(codes_.select("node", "bands"), "node")

    def compare(part: pa.Table) -> pa.Table:
        """Exact links: of each vector their number, and a spanning forest."""
        part = part.combine_chunks()
        size, band = part["size"][0].as_py(), part["band"][0].as_py()
        x = units(part["v"].combine_chunks().flatten().to_numpy().astype(float).reshape(-1, size))
        own = part["bands"].combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        if part["chunk"][0].as_py() >= 0:
            i, j = _inside(part["bucket"].to_numpy())
            sure = [np.einsum("ij,ij->i", x[i[a : a + PAIRS]], x[j[a : a + PAIRS]]) >= threshold for a in range(0, len(i), PAIRS)]
            sure = np.concatenate([np.zeros(0, bool), *sure])
            i, j = i[sure], j[sure]
        else:
            left, right = _sides(part)
            i, j = np.nonzero(x[left] @ x[right].T >= threshold)
            i, j = left[i], right[j]
            if part["p"][0].as_py() == part["q"][0].as_py():
                i, j = i[i < j], j[i < j]
        first = (own[i] == own[j]).argmax(1) == band  # else an earlier band has the pair
        i, j = i[first], j[first]
        copies, nodes = part["copies"].to_numpy(), part["node"].combine_chunks()
        links = np.bincount(i, weights=copies[j], minlength=len(x)) + np.bincount(j, weights=copies[i], minlength=len(x))
        met, tree = np.flatnonzero(links), spanning(len(x), i, j)
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.table({
            "node": pa.concat_arrays([nodes.take(pa.array(met)), none(len(tree))]),
            "links": pa.concat_arrays([pa.array(links[met].astype(np.int64)), none(len(tree))]),
            "a": pa.concat_arrays([none(len(met)), nodes.take(pa.array(i[tree]))]),
            "b": pa.concat_arrays([none(len(met)), nodes.take(pa.array(j[tree]))]),
        })

    found = shared_table(fetched.groupBy(*TILE_KEYS).applyInArrow(compare, "node long, links long, a long, b long"), "tiles")
    links = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.where("a is not null").select("a", "b"))
    by_node = same.select(*key, "node", "rep", "copies").join(links, "node", "left").join(parts, "node", "left")
    by_node = shared_table(by_node.select(*key, "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "nodes")
    least = shared_table(by_node.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    named = shared_table(by_node.join(least, "component").select(*key, "n_links", "component_id"), "named")
    whole = used.join(named, key).select("vec_id", "n_links", "component_id")
    alone = fit.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
