"""Phrases whose words belong together, from position bitmaps of words.

A shard is a stretch of one language's words. Each position has a word or is the end of a piece, so no phrase runs across pieces. A word's positions are a bitmap,
compressed to the containers of 8 positions that hold some. A phrase's bitmap is that of its last words' positions: the phrase's bitmap, shifted by one position,
ANDed with the next word's, whose popcount is the number of occurrences. Phrases are extended depth-first: for a slice of first words all their extensions,
then the extensions of these, before the next slice. Popcounts are summed over all shards.

The corpus is gone through once for each phrase length, as a phrase can only be frequent if what it begins and ends with is frequent. Passes before the last only count
hashes of phrases of one length more; from these comes a filter of FILTER_BITS bits at most, in which every frequent phrase has its bit. The last pass counts the phrases of
all lengths that the filters hold, by their words: a phrase that shares a bit or a hash is counted without need, none is missed, and counts below the least are cut from the sums.

Long texts go through in stretches that repeat the last words but one of a phrase's length, so every occurrence is counted once and no task holds more than a stretch.

Cases: a null text has no words; a null lang counts as `und`; rows that repeat are counted as often; words are told apart by their UTF-8 bytes; words of all lengths count; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import binary, mix, shared_table

#: Occurrences of a candidate, words of the longest ones, percent of a candidate's occurrences from which a longer one stands for it, ranks told.
LEAST, LONGEST, COVERED, TOP = 10, 3, 50, 2_000
#: Bytes of a shard's text, and of all texts that a task holds until one of its languages has as many.
SHARD_BYTES, HELD_BYTES = 4 << 20, 12 << 20
#: Containers of phrases that are extended at once.
SLICE = 50_000
#: Bits of a filter at most (a power of two), bits for each frequent phrase below that, and bits of a part of a filter.
FILTER_BITS, BITS_EACH, PART_BITS = 1 << 27, 16, 1 << 16
#: Languages up to which their least steps are broadcast.
BROADCAST_LANGS = 100_000
#: Score steps by which phrases are counted before the best are sorted: for each doubling.
STEPS = 16

#: What ends a piece, as a byte that no text has, and A-Z lower-cased.
END = b"\xff"
BYTES = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
CUT = re.compile(rb"[ \t\xff]")


class Numbers(dict):
    """Word -> its number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def phrase_hashes(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from the hashes of their first words, second words and so on."""
    out = words[0]
    for x in words[1:]:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + x)
    return out


class Filter:
    """Bits of frequent phrases."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.shift = bits, np.uint64(64 - (len(bits) * 8 - 1).bit_length())

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmaps(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Containers (word, block, bits) of all words, ascending; ids: the word at each position, negative where none is."""
    at = np.flatnonzero(ids >= 0)
    word, block, bit = ids[at], at >> 3, (1 << (at & 7)).astype(np.uint8)
    order = np.argsort(word, kind="stable")
    word, block, bit = word[order], block[order], bit[order]
    begins = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (block[1:] != block[:-1])]) if len(at) else np.zeros(0, int)
    return word[begins], block[begins], np.bitwise_or.reduceat(bit, begins) if len(at) else bit


def mined(ids: np.ndarray, hashes: np.ndarray, longest: int, filters: list[Filter], all_lengths: bool = False, done: int = 0) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Phrases of `longest` words (or of two and more) whose beginnings and ends the filters (of 1, 2, ... words) hold: numbers of their words, and occurrences.

    A phrase may come several times. Phrases that have a filter of their own length are told if it holds them. Those that end before position `done` have been told before.
    """
    ids = np.where((ids >= 0) & filters[0].holds(hashes)[ids], ids, -1)
    word, block, bits = bitmaps(ids)
    by = np.argsort(block, kind="stable")
    next_word, next_bits = word[by], bits[by]
    starts = np.searchsorted(block[by], np.arange(len(ids) // 8 + 3))

    def extend(prefix: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """(prefix, next word, block, bits) where a phrase is followed by a word."""
        moved = np.concatenate([bits << 1, bits >> 7]).astype(np.uint8)  # the last position of a block goes to the next one
        prefix, block = np.concatenate([prefix, prefix]), np.concatenate([block, block + 1])
        some = np.flatnonzero(moved)
        prefix, block, moved = prefix[some], block[some], moved[some]
        n = starts[block + 1] - starts[block]
        which = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n - starts[block], n)
        both = moved[which] & next_bits[at]
        hit = np.flatnonzero(both)
        return prefix[which[hit]], next_word[at[hit]], block[which[hit]], both[hit]

    def deeper(words: list[np.ndarray], prefix: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """words: of the phrases so far; prefix: the phrase of each container."""
        prefix, following, block, bits = extend(prefix, block, bits)
        found, which = np.unique(prefix * len(hashes) + following, return_inverse=True)
        words = [*(w[found // len(hashes)] for w in words), found % len(hashes)]
        # the beginning has been looked up on the way
        fit = filters[len(words) - 2].holds(phrase_hashes([hashes[w] for w in words[1:]])) if len(words) > 2 else np.ones(len(found), bool)
        if len(words) <= len(filters):
            fit &= filters[len(words) - 1].holds(phrase_hashes([hashes[w] for w in words]))
        stay = fit[which]
        if (len(words) == longest or all_lengths) and fit.any():
            new = bits & (255 << np.clip(done - 8 * block, 0, 8) & 255).astype(np.uint8)
            n = np.bincount(which, weights=np.bitwise_count(new), minlength=len(found)).astype(np.int64)
            fit &= n > 0
            yield [w[fit] for w in words], n[fit]
        if len(words) < longest and stay.any():
            yield from deeper(words, which[stay], block[stay], bits[stay])

    for a in range(0, len(word), SLICE):
        first, prefix = np.unique(word[a : a + SLICE], return_inverse=True)
        yield from deeper([first], prefix, block[a : a + SLICE], bits[a : a + SLICE])


def shards(parts: Iterator[pa.RecordBatch], overlap: int) -> Iterator[tuple[str, np.ndarray, list[bytes], int]]:
    """Languages, word numbers (-1: end of a piece) and words of stretches of about SHARD_BYTES, and how many of the numbers repeat the stretch before: `overlap` where one was cut."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def told(lang: str) -> Iterator[tuple[str, np.ndarray, list[bytes], int]]:
        data, at, rest = END.join(held.pop(lang)).translate(BYTES), 0, []
        sizes.pop(lang)
        while at < len(data):
            cut = CUT.search(data, at + SHARD_BYTES) if len(data) - at > 2 * SHARD_BYTES else None
            end = cut.start() if cut else len(data)
            words = rest + data[at:end].replace(END, b" \xff ").split()
            numbers, done = Numbers({END: 0}), len(rest)
            ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) - 1
            at, rest = end, words[max(0, len(words) - overlap) :] if overlap else []
            del words
            yield lang, ids, list(numbers)[1:], done

    for part in parts:
        for lang, text in zip(part["lang"].to_pylist(), binary(part["text"]), strict=True):
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text) + 1
            if sizes[lang] > SHARD_BYTES or sum(sizes.values()) > HELD_BYTES:
                yield from told(max(sizes, key=sizes.get))
    for lang in list(held):
        yield from told(lang)


def word_counts(rows: DataFrame, least: int) -> DataFrame:
    """lang, phrase, h (hash), n of the words that occur `least` times or more in rows (lang, text), and for each lang a row without a phrase that has the number of all. Written."""

    def told(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, words, _ in shards(parts, 0):
            counts = np.bincount(ids[ids >= 0], minlength=len(words))
            hashes = np.append(word_hashes(lang, words), np.uint64(0)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hashes)), pa.array([*words, None], pa.binary()).cast(pa.string()), pa.array(hashes), pa.array(np.append(counts, counts.sum()))], ["lang", "phrase", "h", "n"])

    counted = rows.mapInArrow(told, "lang string, phrase string, h long, n long").groupBy("lang", "phrase", "h").agg(F.sum("n").alias("n"))
    return shared_table(counted.where((F.col("n") >= least) | F.col("phrase").isNull()), "words")


def frequent_hashes(rows: DataFrame, length: int, filters: list[Filter], least: int) -> DataFrame:
    """h: hashes of phrases of `length` words that occur `least` times or more; written."""
    sent = rows.sparkSession.sparkContext.broadcast(filters)  # FILTER_BITS each at most

    def told(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, words, _ in shards(parts, length - 1):
            hashes = word_hashes(lang, words)
            for places, n in mined(ids, hashes, length, sent.value) if words else []:
                yield pa.RecordBatch.from_arrays([pa.array(phrase_hashes([hashes[w] for w in places]).view(np.int64)), pa.array(n)], ["h", "n"])

    counted = rows.mapInArrow(told, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return shared_table(counted.where(F.col("n") >= least).select("h"), "hashes")


def phrase_counts(rows: DataFrame, longest: int, filters: list[Filter], least: int) -> DataFrame:
    """lang, phrase, words (their number), n of the phrases of two to `longest` words that occur `least` times or more; written."""
    sent = rows.sparkSession.sparkContext.broadcast(filters)

    def told(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, words, done in shards(parts, longest - 1):
            spelt = pa.array(words, pa.binary()).cast(pa.string())
            for places, n in mined(ids, word_hashes(lang, words), longest, sent.value, True, done) if words else []:
                phrases = pa.compute.binary_join_element_wise(*(spelt.take(pa.array(w)) for w in places), " ")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), phrases, pa.array(np.full(len(n), len(places), np.int32)), pa.array(n)], ["lang", "phrase", "words", "n"])

    counted = rows.mapInArrow(told, "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return shared_table(counted.where(F.col("n") >= least), "phrases")


def phrase_filter(hashes: DataFrame) -> Filter:
    """The filter of phrases (h), built in parts of PART_BITS."""
    wanted = BITS_EACH * max(1, hashes.count())
    size = min(FILTER_BITS, max(PART_BITS, 1 << (wanted - 1).bit_length()))

    def built(part: pa.Table) -> pa.Table:
        bits = np.zeros(PART_BITS, np.uint8)
        bits[part["bit"].to_numpy() % PART_BITS] = 1
        return pa.table({"part": part["part"].slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})

    bits = hashes.select(F.shiftrightunsigned("h", 64 - (size - 1).bit_length()).alias("bit")).distinct().withColumn("part", F.floor(F.col("bit") / PART_BITS))
    out = np.zeros(size // 8, np.uint8)
    for row in bits.groupBy("part").applyInArrow(built, "part long, bits binary").toLocalIterator():
        out[row["part"] * PART_BITS // 8 : (row["part"] + 1) * PART_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return Filter(out)


def _joined(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def best_of(scored: DataFrame, top: int) -> DataFrame:
    """Of each lang the rows among which its `top` best are, so that no task sorts a language's other phrases.

    A histogram of steps of score tells how far down these reach, then one of scores and, among equal ones, steps of a. Steps of a count only among equal scores: of two scores in one step the higher comes first, whatever its a.
    """
    step = lambda c: F.floor(STEPS * F.log2(F.col(c) + 1.0)).cast("int")
    for key in (step("score"), F.struct("score", step("a").alias("a"))):
        placed = scored.withColumn("_step", key)
        held = placed.groupBy("lang", "_step").agg(F.count("*").alias("n"))
        above = F.coalesce(F.sum("n").over(W.partitionBy("lang").orderBy(F.desc("_step")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        reach = shared_table(held.withColumn("_above", above).where(F.col("_above") < top).groupBy("lang").agg(F.min("_step").alias("_least")), "reach")
        # a row for each language
        scored = placed.join(F.broadcast(reach) if reach.count() <= BROADCAST_LANGS else reach, "lang").where(F.col("_step") >= F.col("_least")).drop("_step", "_least")
    return scored


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of documents (lang, text)."""
    rows = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    single = word_counts(rows, least)
    known = single.where(F.col("phrase").isNotNull())
    filters = [phrase_filter(known.select("h"))]
    for m in range(2, longest):
        filters.append(phrase_filter(frequent_hashes(rows, m, filters, least)))
    candidates = phrase_counts(rows, longest, filters, least)
    every = known.select("lang", "phrase", "n").unionByName(candidates.where(F.col("words") < longest).select("lang", "phrase", "n"))
    words = F.split("phrase", " ")
    cut = candidates.select("lang", "phrase", F.col("n").alias("a"), words.alias("words")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    parted = cut.select("lang", "phrase", "a", "k", _joined(F.col("words"), 1, F.col("k")).alias("left"), _joined(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    part = lambda side, n: every.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    met = parted.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("cast(1000000 * cast(a as decimal(16, 0)) * cast(a as decimal(16, 0)) as decimal(38, 0)) div (cast(l as decimal(16, 0)) * cast(r as decimal(16, 0)))")
    lowest = met.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_cut"))
    scored = lowest.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    if longest > 2:
        spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size(words) - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size(words) - m + 1), lambda i: _joined(words, i, m))))
        inside = candidates.where(F.col("words") > 2).select("lang", F.explode(spans).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("_longer"))
        scored = scored.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < covered * F.col("a"), F.lit(True))).drop("_longer")
    best = best_of(shared_table(scored, "scored"), top)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    total = single.where(F.col("phrase").isNull()).select("lang", "n")
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
