"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target size, so each of its rows should be copied target / source size times. The whole part of that is taken
by every row; of the fractional part, two rows at a time move mass between each other until one of them is whole: the words that
the pair takes together stay the same, and each row's expected number of copies does too. What one group of rows leaves is one
fractional row at most; these meet again in groups of FAN, level by level, until one row of each source is left and drawn by itself.
So a source's taken words differ from its target by less than one row's size.

All draws follow from a hash of doc_id and the level, so reruns agree.

Cases: a null text has size 0; rows of size 0 take no words; a null source is a source of its own and stands last; k repeated rows are one row of
the tree that stands for k times the fraction, and as many of them as that yields take one copy more; an empty table gives an empty result; other
columns pass through, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import free, n_words, shared_table

#: Rows of a group on the lowest level, about.
LEAF_ROWS = 2_048
#: Residual rows that meet in a group on each level above.
FAN = 256
#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source gives at most so many times its size.
MOST = 3.0


def source_targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, n_rows, target of each source. rows has source and size.

    The targets share the total by weight; those beyond `most` times their source's size stop there and the rest is shared again.
    That has a closed form: with sources sorted by cap / weight, the first k stop at their caps, k being the first at which the
    level (total - caps so far) / (weights left) does not exceed the next cap / weight. One row for each source.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    ranked = by.withColumn("_k", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    weighed = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_k") + 1).cast("int"))).withColumn("_cap", most * F.col("source_size"))
    order = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    marked = weighed.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("_w") <= F.col("_cap"))
    # the level of the first source that is not stopped holds for all after it
    water = F.min(F.when(F.col("_free"), F.struct((F.col("_cap") / F.col("_w")).alias("at"), F.col("source").isNull().alias("last"), F.col("source").alias("source"), F.col("_level").alias("level")))).over(W.partitionBy())
    target = F.least(F.col("_cap"), F.coalesce(water["level"] * F.col("_w"), F.col("_cap")))
    return marked.select("source", "source_size", "n_rows", target.alias("target"))


def _uniform(ids: np.ndarray, level: int) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53


def pivot(share: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """share, rounded in pairs to 0 or 1 but for one row at most; the sum of share * size stays the same."""
    out = share.copy()
    open_ = -1
    for j in range(len(out)):
        if size[j] == 0 or not 0 < out[j] < 1:
            if size[j] == 0:
                out[j] = 0.0
            continue
        if open_ < 0:
            open_ = j
            continue
        i, a, b = open_, size[open_], size[j]
        up = min((1 - out[i]) * a, out[j] * b)  # words that i can take from j
        down = min(out[i] * a, (1 - out[j]) * b)
        moved = up if draw[j] * (up + down) < down else -down
        x, y = out[i] + moved / a, out[j] - moved / b
        x, y = (round(x) if abs(x - round(x)) < 1e-9 else x), (round(y) if abs(y - round(y)) < 1e-9 else y)
        out[i], out[j] = x, y
        open_ = i if 0 < x < 1 else j if 0 < y < 1 else -1
    return out


def _rounder(level: int):
    def rounded(part: pd.DataFrame) -> pd.DataFrame:
        # from large to small: the row that stays open is then one of the small ones
        part = part.sort_values(["size", "_hash", "_share"], ascending=[False, True, True], kind="stable", ignore_index=True)
        part["_share"] = pivot(part["_share"].to_numpy(float), part["size"].to_numpy(float), _uniform(part["_hash"].to_numpy(), level))
        return part

    return rounded


def copies(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target and copies, a whole number, for each row of rows (doc_id, source, text)."""
    slim = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", n_words(F.col(text)).alias("size"), F.lit(0).cast("long").alias("rest"))
    return _copies(shared_table(slim, "sizes"), weights, most).drop("row")


def _copies(slim: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """slim: row (unique), doc_id, source, size and rest, a hash of what else tells rows apart; written, as it is read more than once."""
    sources = shared_table(source_targets(slim, weights, most), "sources")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # rows that agree in all of this are one row of the tree, with all their fractions; whole ones among these need no draw
    same = ["doc_id", "source", "size", "rest"]
    given = slim.groupBy(*same).agg(F.count("*").alias("k")).join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor(ratio + F.lit(1e-12))
    mass = F.when(F.col("size") > 0, F.greatest(F.lit(0.0), ratio - whole) * F.col("k")).otherwise(0.0)
    ones = F.floor(mass + F.lit(1e-12))
    leaves = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / LEAF_ROWS))
    hashed = lambda seed: F.xxhash64(F.lit(seed), "doc_id", "size", "rest")
    started = given.select(
        *same, "k", "source_size", "target", whole.cast("long").alias("_whole"), ones.cast("long").alias("_ones"), F.greatest(F.lit(0.0), mass - ones).alias("_share"),
        hashed(11).alias("_hash"), F.pmod(hashed(5), leaves).alias("_group"),
    )
    level, decided, open_ = 0, None, started
    groups = (sources.agg(F.max("n_rows")).first()[0] or 0) // LEAF_ROWS + 1
    while True:
        done = shared_table(open_.groupBy("source", "_group").applyInPandas(_rounder(level), open_.schema), f"mix{level}")
        fixed = done.where((F.col("_share") == 0) | (F.col("_share") == 1))
        decided = fixed if decided is None else decided.unionByName(fixed)
        open_ = done.where((F.col("_share") > 0) & (F.col("_share") < 1)).withColumn("_group", F.floor(F.col("_group") / FAN))
        if groups <= 1:
            break
        groups, level = -(-groups // FAN), level + 1
    # one row of each source at most is left: it is drawn by itself
    draw = F.pmod(F.xxhash64(F.lit(13), "_hash"), F.lit(1 << 30)) / float(1 << 30)
    last = open_.withColumn("_share", F.when(draw < F.col("_share"), 1.0).otherwise(0.0))
    told = decided.unionByName(last).select(*same, "k", "source_size", "target", "_whole", (F.col("_ones") + F.col("_share").cast("long")).alias("_more"))
    told = shared_table(told.withColumn("_key", F.monotonically_increasing_id()), "decided")
    by = told.select(*(F.col(c).alias(f"_{c}") for c in same), "k", "source_size", "target", "_whole", "_more", "_key")
    rows = slim.join(by, (F.col("size") == F.col("_size")) & (F.col("rest") == F.col("_rest")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")))
    # of k equal rows as many as have a one take one more: they are numbered within a part of the table, and the parts' numbers of them are summed
    several = rows.where((F.col("k") > 1) & (F.col("_more") > 0)).select("row", "_key", "_more", F.shiftright("row", 33).alias("_part"))
    sums = several.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    before = sums.select("_key", "_part", F.coalesce(F.sum("_n").over(W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.row_number().over(W.partitionBy("_key", "_part").orderBy("row"))
    chosen = several.withColumn("_at", number).join(before, ["_key", "_part"]).where(F.col("_at") + F.col("_before") <= F.col("_more")).select("row", F.lit(1).alias("_one"))
    final = rows.join(chosen, "row", "left").withColumn("_extra", F.when(F.col("k") == 1, F.col("_more")).otherwise(F.coalesce("_one", F.lit(0))))
    return final.select("row", "doc_id", "source", "size", "source_size", "target", (F.col("_whole") + F.col("_extra")).alias("copies"))


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, text: str = "text") -> DataFrame:
    """documents with every row repeated as often as the mix takes it; rows that it takes 0 times are gone."""
    row, size, n, copy = free(documents.columns, "row", "size", "n", "copy")
    told = F.xxhash64(*[F.col(c) for c, kind in documents.dtypes if "map<" not in kind])
    # the rows are written with their numbers: a number made anew could stand for another row
    staged = shared_table(documents.select("*", F.monotonically_increasing_id().alias(row), n_words(F.col(text)).alias(size)), "numbered")
    slim = shared_table(staged.select(F.col(row).alias("row"), "doc_id", "source", F.col(size).alias("size"), told.alias("rest")), "sizes")
    taken = _copies(slim, weights, most).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(n))
    return staged.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*documents.columns)
