"""URL filters by a temporal list join.

A list entry says from a day on whether a pattern (a URL, a host, or a parent domain of hosts) is listed. A pattern's entries become disjoint
validity intervals; every capture asks for its URL, its host and the host's parent domains, and meets the interval that
holds its fetch day. An interval is covered by blocks of 2**k days that start at multiples of their length, at most two for each k, so by at most 62 rows
whatever its days are, and an interval without an end is no longer than any other. A capture that asks for a listed pattern looks its day up in the blocks
of the lengths that this pattern has, and lies in one of them at most for each interval.
Patterns that very many captures ask for are salted: the captures are dealt over several keys, and the pattern's rows stand under each.

Cases: a URL is lower-cased in scheme and host only; scheme, user, port and fragment are not part of a pattern; a null or empty URL, or one
without a host, asks for nothing and is allowed; a capture without a fetch day is allowed; entries with a null pattern, day or action
are left out; of several entries of a pattern on one day a listing wins; repeated entries and captures are harmless and stay; empty tables give
all captures allowed, or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import shared_table

#: Bits of a day's number; days count from -2**(DAY_BITS - 1).
DAY_BITS = 32
#: Captures that ask for a pattern under one key, about.
HOT_ASKS = 100_000
#: Hot patterns up to which they are broadcast; beyond, they are joined.
BROADCAST_ROWS = 100_000


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def page(url: Column) -> Column:
    """The URL without scheme, user, port and fragment; empty where there is no host."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(host(url) != "", F.concat(host(url), rest)).otherwise("")


def patterns(url: Column) -> Column:
    """What a capture asks for: structs of rank (1 its page, 2 its host, 3 and on the parent domains of two labels or more) and pattern."""
    labels = F.split(host(url), r"\.")
    count = F.size(labels)
    parents = F.transform(F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), count - 1)), lambda k: k <= count - 1), lambda k: F.struct((k + 1).cast("int").alias("rank"), F.concat(F.lit("."), F.concat_ws(".", F.slice(labels, k, count))).alias("pattern")))
    own = F.array(F.struct(F.lit(1).alias("rank"), F.concat(F.lit("="), page(url)).alias("pattern")), F.struct(F.lit(2).alias("rank"), host(url).alias("pattern")))
    return F.when(F.coalesce(host(url), F.lit("")) != "", F.concat(own, parents)).otherwise(F.array().cast("array<struct<rank:int,pattern:string>>"))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, first_day, end_day (exclusive; null where it is still listed) of the disjoint intervals in which a pattern is listed.

    entries: pattern string, day int, listed boolean. A pattern has one state for each day at most, so its array stays
    within the number of days that the lists cover.
    """
    good = entries.where(F.col("pattern").isNotNull() & F.col("day").isNotNull() & F.col("listed").isNotNull())
    by_day = good.groupBy("pattern", "day").agg(F.max("listed").alias("listed"))
    lines = by_day.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("day", "listed"))).alias("days"))
    spans = F.transform("days", lambda d, i: F.struct(d["listed"].alias("listed"), d["day"].alias("first_day"), F.get("days", i + 1)["day"].alias("end_day")))
    return lines.select("pattern", F.inline(spans)).where("listed").select("pattern", "first_day", "end_day")


def covered(first: str, end: str) -> Column:
    """array<struct<level, node>>: the blocks of 2**level days that make up the days from first to end - 1 (columns; an end that is null is no end)."""
    a = f"(cast({first} as long) + {1 << DAY_BITS - 1})"
    b = f"coalesce(cast({end} as long) + {1 << DAY_BITS - 1}, {1 << DAY_BITS})"
    # the blocks of level k that lie in the interval are those from lo to hi - 1; the outermost ones do not pair up to a larger block
    edges = f"transform(sequence(0, {DAY_BITS}), k -> named_struct('level', k, 'lo', shiftright({a} + shiftleft(1L, k) - 1, k), 'hi', shiftright({b}, k)))"
    left = "if(e.lo < e.hi and e.lo % 2 = 1, named_struct('level', e.level, 'node', e.lo), null)"
    right = "if(e.lo < e.hi and e.hi % 2 = 1, named_struct('level', e.level, 'node', e.hi - 1), null)"
    return F.expr(f"filter(flatten(transform({edges}, e -> array({left}, {right}))), x -> x is not null)")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetch_day", key: str = "page_id") -> DataFrame:
    """captures' key, fetch day, n_listed (patterns of the capture listed on its day), the most specific such pattern and its first_day, and blocked."""
    blocks = shared_table(intervals(entries).withColumn("block", F.explode(covered("first_day", "end_day"))).select("pattern", "block.level", "block.node", "first_day"), "blocks")
    asked = captures.select(F.col(key).alias("key"), F.xxhash64(url).alias("u"), F.col(day).cast(T.IntegerType()).alias("day"), F.explode(patterns(F.col(url))).alias("ask")).where("day is not null").select("key", "u", "day", "ask.rank", "ask.pattern")
    hot = asked.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ASKS).select("pattern", F.ceil(F.col("n") / HOT_ASKS).cast("int").alias("salts"))
    hot = shared_table(hot, "hot")
    salted = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    # equal captures fall under one salt, or under several by number
    spread = asked.join(salted, "pattern", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("key", "u", "day", F.monotonically_increasing_id()), F.col("salts")), F.lit(0).cast("long"))).drop("salts")
    salts = lambda rows: rows.join(salted, "pattern", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - F.lit(1).cast("long")))).drop("salts")
    # what nobody lists goes first; the others learn which lengths of blocks their pattern has
    levels = salts(blocks.groupBy("pattern").agg(F.collect_set("level").alias("levels")))
    looked = spread.join(levels, ["pattern", "salt"]).withColumn("level", F.explode("levels")).withColumn("node", F.expr(f"shiftright(cast(day as long) + {1 << DAY_BITS - 1}, level)")).drop("levels")
    met = looked.join(salts(blocks), ["pattern", "salt", "level", "node"])
    hits = met.groupBy("key", "u", "day").agg(F.count_distinct("rank").alias("n_listed"), F.min(F.struct("rank", "pattern", "first_day")).alias("best"))
    mine = captures.select(F.col(key), F.col(day).cast(T.IntegerType()).alias(day), F.xxhash64(url).alias("_u"))
    whole = mine.join(hits, F.col(key).eqNullSafe(hits["key"]) & F.col(day).eqNullSafe(hits["day"]) & (F.col("_u") == hits["u"]), "left")
    return whole.select(mine[key], mine[day], F.coalesce("n_listed", F.lit(0)).cast("long").alias("n_listed"), F.col("best.pattern").alias("pattern"), F.col("best.first_day").alias("listed_since"), F.col("best").isNotNull().alias("blocked"))
