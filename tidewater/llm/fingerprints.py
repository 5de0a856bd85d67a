"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs, with DataFrame functions only.

A text falls into paragraphs: lines, long ones being cut at sentence ends or after about 100 characters. A paragraph's digest is 48 bits of its hash under 16 bits of check.
A sketch has 24 cells in 3 rows; each digest falls into one cell of each row, and a cell holds a count and the exclusive
or of its digests. The sketches of two versions subtract cell by cell; what both hold is gone, and a cell that is left with one digest
gives it away (its check and place are right), which may leave others with one. When no such cell is left before all are empty, the digests are
dealt into eight parts, each with a sketch of its own, and so on: a failure costs a larger sketch of the part that failed.

The likeness of two texts is the share of common paragraphs among all distinct ones, from the numbers of paragraphs and those recovered.

Cases: a null text is an empty one and has the digest of the empty paragraph; a version whose digests are null has none; repeated paragraphs of a text count once; equal texts have equal fingerprints;
an empty table gives an empty result; other columns pass through `fingerprint` and `differences`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import free, others, partitions, shared_table

#: A paragraph: 32 characters of a line and up to 64 more as far as the sentence's end, or what is left of the line. So one ends within the first 100 characters of a line.
PARAGRAPH = r"[^\n]{32}[^\n.!?]{0,64}[.!?]{0,3} ?|[^\n]+"
ROWS, PLACES = 3, 8
#: Parts that a failed part is dealt into, and how often this is done before the rest is written down and taken up again.
PARTS, LEVELS = 8, 3
#: Levels after which a part that still fails is an error: by then the digests have been dealt into more parts than there are digests.
DEEPEST = 30
#: Rounds of peeling; a sketch that needs more counts as failed.
PEELS = 10
LOW48 = (1 << 48) - 1


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _digest(paragraph: Column) -> Column:
    low = F.xxhash64(paragraph).bitwiseAND(F.lit(LOW48))
    return _let(low, lambda x: x.bitwiseOR(F.shiftleft(F.xxhash64(x, F.lit(99)), 48)))


def _sound(digest: Column) -> Column:
    """Whether a cell's bits are one digest: its check is right."""
    low = digest.bitwiseAND(F.lit(LOW48))
    return F.shiftleft(F.xxhash64(low, F.lit(99)), 48) == digest.bitwiseAND(F.lit(~LOW48))


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(""))), _digest))


def _spread(digest: Column, level: Column | int) -> Column:
    return F.xxhash64(digest, level if isinstance(level, Column) else F.lit(level))


def _place(spread: Column, row: int) -> Column:
    return F.shiftrightunsigned(spread, 3 * row).bitwiseAND(F.lit(PLACES - 1)).cast("int")


def sketch(keys: Column, level: Column | int = 0) -> Column:
    """array<struct<n int, x bigint>> of ROWS * PLACES cells."""
    places = F.transform(keys, lambda k: _let(_spread(k, level), lambda s: F.struct(k.alias("k"), *[_place(s, r).alias(f"p{r}") for r in range(ROWS)])))

    def row(found: Column, r: int) -> Column:
        def cell(place: Column) -> Column:
            mine = F.filter(found, lambda k: k[f"p{r}"] == place)
            return _let(mine, lambda m: F.struct(F.size(m).alias("n"), F.aggregate(m, F.lit(0).cast("long"), lambda held, k: held.bitwiseXOR(k["k"])).alias("x")))

        return F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), cell)

    return _let(places, lambda found: F.concat(*[row(found, r) for r in range(ROWS)]))


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.struct((a["n"] - b["n"]).alias("n"), a["x"].bitwiseXOR(b["x"]).alias("x")))


def _empty(cells: Column) -> Column:
    return F.forall(cells, lambda c: (c["n"] == 0) & (c["x"] == 0))


def peel(cells: Column, level: Column | int) -> Column:
    """struct<cells, found array<struct<k bigint, n int>>>: what is left of a difference, and the digests recovered (n 1: left only, -1: right only)."""

    def pure(cell: Column, at: Column) -> Column:
        spread = _spread(cell["x"], level)
        here = F.lit(False)
        for r in range(ROWS):
            here = here | ((at >= r * PLACES) & (at < (r + 1) * PLACES) & (_place(spread, r) + r * PLACES == at))
        return F.when((F.abs(cell["n"]) == 1) & _sound(cell["x"]) & here, F.struct(cell["x"].alias("k"), cell["n"].alias("n")))

    def without(cells: Column, gone: Column) -> Column:
        placed = F.transform(gone, lambda g: _let(_spread(g["k"], level), lambda s: F.struct(g["k"].alias("k"), g["n"].alias("n"), F.array(*[_place(s, r) + r * PLACES for r in range(ROWS)]).alias("at"))))

        def less(found: Column) -> Column:
            def cell(c: Column, i: Column) -> Column:
                return F.aggregate(found, c, lambda held, g: F.when(F.array_contains(g["at"], i), F.struct((held["n"] - g["n"]).alias("n"), held["x"].bitwiseXOR(g["k"]).alias("x"))).otherwise(held))

            return F.transform(cells, cell)

        return _let(placed, less)

    def turn(state: Column, _: Column) -> Column:
        gone = F.array_distinct(F.filter(F.transform(state["cells"], pure), lambda p: p.isNotNull()))
        step = _let(gone, lambda g: F.struct(without(state["cells"], g).alias("cells"), F.concat(state["found"], g).alias("found"), (F.size(g) > 0).alias("on")))
        return F.when(state["on"], step).otherwise(state)

    start = F.struct(cells.alias("cells"), F.array().cast("array<struct<k:bigint,n:int>>").alias("found"), F.lit(True).alias("on"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(PEELS)), start, turn)


def _tried(difference: Column, a: Column, b: Column, level: Column | int) -> Column:
    """struct<ok, found, a, b>: the digests of both sides stay only where peeling failed."""
    none = F.array().cast("array<bigint>")

    def outcome(p: Column) -> Column:
        return F.when(F.coalesce(_empty(p["cells"]), F.lit(False)), F.struct(F.lit(True).alias("ok"), p["found"].alias("found"), none.alias("a"), none.alias("b"))).otherwise(F.struct(F.lit(False).alias("ok"), F.array().cast("array<struct<k:bigint,n:int>>").alias("found"), a.alias("a"), b.alias("b")))

    return _let(peel(difference, level), outcome)


def _deeper(states: Column, level: Column | int) -> Column:
    """What failed, dealt into PARTS and tried again."""

    def part(keys: Column, q: Column) -> Column:
        return F.filter(keys, lambda k: F.shiftrightunsigned(_spread(k, level), 12).bitwiseAND(F.lit(PARTS - 1)) == q)

    def again(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda q: _let(F.struct(part(s["a"], q).alias("a"), part(s["b"], q).alias("b")), lambda x: _tried(subtract(sketch(x["a"], level + 1), sketch(x["b"], level + 1)), x["a"], x["b"], level + 1)))

    return F.flatten(F.transform(F.filter(states, lambda s: ~s["ok"]), again))


def _found(states: Column) -> Column:
    return F.flatten(F.transform(states, lambda s: s["found"]))


def _levels(rows: DataFrame, columns: list[str], states: list[str], found: list[str], at: str, counts: bool) -> DataFrame:
    """Tries LEVELS larger sketches of what failed in each state, adding to its column of found what is recovered. columns: the others; at: the column of the level."""
    # built once, as an expression of columns: each takes thousands of calls
    deeper = [_deeper(F.col(s), F.col(at)).alias(s) for s in states]
    more = [_found(F.col(s)) for s in states]
    grown = [(F.col(f) + F.size(m) if counts else F.concat(F.col(f), m)).alias(f) for f, m in zip(found, more, strict=True)]
    for _ in range(LEVELS):
        rows = rows.select(*columns, *found, *deeper, (F.col(at) + 1).alias(at)).select(*columns, *states, *grown, at)
    return rows


def differences(rows: DataFrame, pairs: dict[str, tuple[str, str]], counts: bool = False) -> DataFrame:
    """rows with a column for each name of pairs: array<struct<k, n>> of the digests that one side alone has (n 1: left, -1: right), or their number.

    pairs: name -> prefixes of the columns <prefix>_keys (digests) and <prefix>_cells (their sketch) of the two versions; these columns go. Other columns pass
    through, whatever they are called, but for those called as the names, which give way.
    """
    # a side that is missing has no digests
    rows = rows.withColumns({f"{x}_keys": F.coalesce(f"{x}_keys", F.array().cast("array<bigint>")) for pair in pairs.values() for x in pair})
    none = F.transform(F.sequence(F.lit(1), F.lit(ROWS * PLACES)), lambda _: F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("x")))
    rows = rows.withColumns({f"{x}_cells": F.coalesce(f"{x}_cells", none) for pair in pairs.values() for x in pair})
    columns = others(rows.columns, *pairs, *(f"{x}_{y}" for pair in pairs.values() for x in pair for y in ("keys", "cells")))
    held = free([*rows.columns, *pairs], "open", "level", *(f"state{i}" for i in range(len(pairs))), *(f"found{i}" for i in range(len(pairs))))
    open_, at, states, found = held[0], held[1], held[2 : len(pairs) + 2], held[len(pairs) + 2 :]
    tried = [F.array(_tried(subtract(F.col(f"{a}_cells"), F.col(f"{b}_cells")), F.col(f"{a}_keys"), F.col(f"{b}_keys"), 0)) for a, b in pairs.values()]
    rows = rows.select(*columns, *[t.alias(s) for t, s in zip(tried, states, strict=True)])
    rows = rows.select("*", *[(F.size(_found(F.col(s))) if counts else _found(F.col(s))).alias(f) for s, f in zip(states, found, strict=True)], F.lit(0).alias(at))

    def marked(rows: DataFrame) -> DataFrame:
        """Of the states only those that failed."""
        left = rows.select(*columns, *found, at, *[F.filter(s, lambda x: ~x["ok"]).alias(s) for s in states])
        return left.withColumn(open_, sum((F.size(s) for s in states), F.lit(0)) > 0)

    # what still fails (thousands of differing paragraphs, or an unlucky few) is written down and taken up until nothing is left
    level, state = LEVELS, shared_table(marked(_levels(rows, columns, states, found, at, counts)), "sketches")
    done = state.where(~F.col(open_))
    while (state := state.where(F.col(open_)).drop(open_)).head(1):
        if level > DEEPEST:
            raise RuntimeError("digests that no larger sketch tells apart")
        state = shared_table(marked(_levels(state, columns, states, found, at, counts)), "sketches")
        done = done.unionByName(state.where(~F.col(open_)))
        level += LEVELS
    return done.select(*columns, *[F.col(f).alias(x) for f, x in zip(found, pairs, strict=True)])


def written(keys: Column, cells: Column) -> Column:
    """A sketch as text: the number of digests, then each cell's count modulo 256 and bits in hexadecimal."""
    cell = F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["n"].bitwiseAND(F.lit(255))), 2, "0"), F.lpad(F.hex(c["x"]), 16, "0")))
    return F.concat(F.size(keys).cast("string"), F.lit(":"), F.lower(F.concat_ws("", cell)))


def fingerprint(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with a column fingerprint, which replaces one that is called so."""
    columns = others(documents.columns, "fingerprint")
    (keys,) = free(columns, "keys")
    named = documents.select(*columns, digests(F.col(text)).alias(keys))
    return named.select(*columns, written(F.col(keys), sketch(F.col(keys))).alias("fingerprint"))


def neighbours(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) in buckets of neighbouring rows: doc_id, text, _h (a hash of the text), _m (the row's number), _bucket, _ghost.

    Rows stand in the order of doc_id (null ids first), _h and _m, so rows that repeat a doc_id, or lack one, fall into several buckets too. A bucket's last
    row stands once more, as a ghost, in front of the next bucket, and the table's last row in front of the first: every row finds
    the one before it within its bucket. The ghosts are the buckets' actual last keys, found by an aggregation of the same keys.
    """
    named = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_m"))
    key = ["doc_id", "_h", "_m"]
    ranged = named.select(*key).repartitionByRange(4 * partitions(documents.sparkSession), *key)
    lasts = ranged.select(F.spark_partition_id().alias("p"), F.struct(*key).alias("k")).groupBy("p").agg(F.max("k").alias("k"))
    # one row: the last key of each bucket, ascending, as many as there are partitions
    bounds = shared_table(lasts.agg(F.array_sort(F.collect_list("k")).alias("_lasts")), "bounds")
    placed = named.join(F.broadcast(bounds)).withColumn("_k", F.struct(*key)).withColumn("_bucket", _lower_bound(F.col("_lasts"), F.col("_k")))
    n = F.size("_lasts")
    is_last = F.get("_lasts", F.col("_bucket")) == F.col("_k")
    spots = F.filter(
        F.array(
            F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("g")),
            F.when(is_last, F.struct(((F.col("_bucket") + 1) % n).alias("b"), F.lit(True).alias("g"))),
        ),
        lambda s: s.isNotNull(),
    )
    return placed.select("doc_id", "text", "_h", "_m", F.explode(spots).alias("_spot")).select("doc_id", "text", "_h", "_m", F.col("_spot.b").alias("_bucket"), F.col("_spot.g").alias("_ghost"))


def _lower_bound(ascending: Column, value: Column) -> Column:
    """The place of the first element that is not below value, by bisection."""
    n = F.size(ascending)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))

    def halved(s: Column, _: Column) -> Column:
        middle = F.floor((s["a"] + s["b"]) / 2).cast("int")
        below = F.get(ascending, middle) < value
        return F.when(s["a"] < s["b"], F.struct(F.when(below, middle + 1).otherwise(s["a"]).alias("a"), F.when(below, s["b"]).otherwise(middle).alias("b"))).otherwise(s)

    # a key that the bounds do not know yet would lie beyond the last
    return F.least(F.aggregate(steps, F.struct(F.lit(0).alias("a"), n.alias("b")), halved)["a"], n - 1)


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """For every row of documents (doc_id, text): its text's fingerprint, that of its edited text, and their likeness.

    Edited: the last third of the code points gives way to as many of the next document's first ones (all if it has fewer). Next: in descending order of
    doc_id, null ids last, equal ids in the order of a hash of their texts; the first row follows the last.
    """
    order = W.partitionBy("_bucket").orderBy(F.col("_ghost").desc(), F.col("doc_id").asc_nulls_first(), "_h", "_m")
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    paired = neighbours(documents).withColumn("_next", F.lag("text").over(order))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), third))
    told = paired.select("doc_id", "_bucket", "_ghost", "_h", "_m", n.cast("long").alias("n_chars"), edited.alias("_edited"), digests(F.col("text")).alias("own_keys"))
    told = told.select("doc_id", "_bucket", "_ghost", "_h", "_m", "n_chars", F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"), "own_keys", digests(F.col("_edited")).alias("edited_keys"))
    told = told.withColumn("own_cells", sketch(F.col("own_keys"))).withColumn("edited_cells", sketch(F.col("edited_keys")))
    told = told.withColumn("next_keys", F.lag("own_keys").over(order)).withColumn("next_cells", F.lag("own_cells").over(order)).where("not _ghost")
    told = told.withColumn("fingerprint", written(F.col("own_keys"), F.col("own_cells"))).withColumn("edited_fingerprint", written(F.col("edited_keys"), F.col("edited_cells")))
    told = told.withColumns({f"{x}_n": F.size(f"{x}_keys") for x in ("own", "edited", "next")})
    found = differences(told, {"to_edited": ("own", "edited"), "to_next": ("own", "next")}, counts=True)

    def near(other: str, differing: str) -> Column:
        total, d = F.col("own_n") + F.col(f"{other}_n"), F.col(differing)
        return ((total - d) / (total + d)).cast("double")

    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited", "to_edited").alias("near_edited"), near("next", "to_next").alias("near_next"))
