"""Language-model scores from a hierarchical Pitman-Yor model of word pairs.

Every word is a context with a restaurant of its own, whose customers are the words that followed it in training; all of these share one
parent restaurant, whose customers are their tables, and whose parent is uniform over the training vocabulary and one unknown word.
Seating is sampled by Gibbs sweeps that alternate over the hierarchy: in each round all customers of a dish leave their context's restaurant and sit
down again one after the other, given the others' tables of the round before and the parent's probabilities; the tables become the parent's customers, who sit down
again in turn. The first round starts from one table for each dish and corpus-wide word shares; BURN rounds later every round is a sample, and
the predictive probabilities are averaged over the samples, each with its own tables of contexts and parent.

The tokens of a batch of documents are packed by context, as (pair, document, times); a group of contexts is one task's arrays. Frequent words are written as numbers by
frequency, which all tasks know (CODES at most), others by their hashes, so what a token takes does not depend on the number of groups. Contexts that hold a large share of all tokens are
spread by pair, and their tables are summed over the groups after every round. Pairs that do are dealt over several groups by batch: each of these scores its part of the tokens, all seat the
pair's customers of the whole corpus and find the same tables, and one of them counts. So no task grows with one word or one pair, and they are sampled like any other. Random numbers are hashes of
(context, word, round, customer), so seating does not depend on groups, batches or partitions.

Words are dealt by hash into slices. A group tells a slice its words and their counts once; in the rounds it tells where dishes have more than one table, which few have, and the slice answers
where words have more customers in the parent than dishes. Probabilities return to the documents as sums for each batch.

Cases: a null or empty text is one end token; the end also stands before a text's first word; rows score apart even if they repeat or lack a doc_id (which
counts as empty text for the fold); words that training does not hold are the unknown word; with no training rows every probability is that of the unknown word;
an empty table gives an empty result. doc_id must be a whole number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import binary, hashed_words, mix, partitions, release, releasing, remainder, shared_table

#: Documents with remainder(doc_id, FOLDS) 0 are held out.
FOLDS = 10
#: Discount and strength of the context restaurants, and of their parent.
DISCOUNT, STRENGTH = 0.8, 2.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.7, 10.0
#: Rounds before samples are taken, and samples.
BURN, SAMPLES = 1, 3
#: Customers sit down one by one along with those of all other dishes, up to this number or as long as there are so many dishes; those after them dish by dish, in blocks.
LONG, FEW, BLOCK = 64, 128, 8_192
#: Characters of text for each group of contexts, about; words of a batch.
GROUP_CHARS, BATCH_WORDS = 14_000_000, 1_000_000
#: Tokens of a group whose probabilities are computed at once.
STRETCH = 1 << 18
#: A word's bits. Shares of a group's tokens from which a context is spread, and a pair is dealt over several groups.
BITS, HOT = 56, 0.25
#: Frequent words that are written as numbers, at most, and occurrences in a batch from which it reports a word. Groups for each slice of words, and slices at least.
CODES, REPORTED, GROUPS_EACH, SLICES = 1 << 18, 8, 4, 12
#: Binary places of sums of logarithms under way.
PLACES = 40
SEED = 11

MASK = np.uint64((1 << BITS) - 1)
END = np.uint64(xxhash.xxh64_intdigest(b"\n") & ((1 << BITS) - 1))


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Numbers below 2**(8 * width), byte plane by byte plane."""
    return _squeeze(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def _unplanes(data: bytes, width: int) -> np.ndarray:
    planes = _expand(data, np.uint8).reshape(width, -1)
    out = planes[0].astype(np.uint64)
    for k in range(1, width):
        out |= planes[k].astype(np.uint64) << np.uint64(8 * k)
    return out


def _distinct(values: np.ndarray) -> np.ndarray:
    """Ascending distinct values, by sorting, which is faster here than np.unique's hash table."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def _tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, an end after each, and the number of tokens of each text."""
    flat, n = hashed_words(texts)
    tokens = np.full(len(flat) + len(n), END, np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(n + 1) - 1] = False
    tokens[inner] = flat & MASK
    return tokens, n + 1


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]]:
    """Rows (row numbers, doc_ids, whether for training, texts) of about BATCH_WORDS words."""
    for part in parts:
        texts = binary(part["text"])
        rows, train = part["row"].to_numpy(), part["train"].to_numpy(zero_copy_only=False)
        ids = part["doc_id"]
        start, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t) if t else 1
            if held > 6 * BATCH_WORDS or i + 1 == len(texts):
                yield rows[start : i + 1], ids.slice(start, i + 1 - start), train[start : i + 1], texts[start : i + 1]
                start, held = i + 1, 0


def _odds(key: np.ndarray, arrival: np.ndarray | int) -> np.ndarray:
    """1 / u - 1 for numbers u in (0, 1) from keys and the customers' places."""
    place = np.asarray(arrival).astype(np.uint64).reshape(-1) * np.uint64(0x9E3779B97F4A7C15)
    return 2.0**53 / ((mix(key + place) >> np.uint64(11)) + 0.5) - 1


def _keys(*parts: np.ndarray | int) -> np.ndarray:
    """Keys from whole numbers (arrays and scalars)."""
    out = np.zeros(1, np.uint64)
    for x in parts:
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + np.asarray(x).astype(np.uint64) + np.uint64(SEED))
    return out


def seat(customers: np.ndarray, prior: np.ndarray, other: np.ndarray, discount: float, strength: float, key: np.ndarray) -> np.ndarray:
    """Tables after all customers of each dish sat down again, one after the other. other: tables of the restaurant's other dishes; key: a number of each dish.

    With s customers at t tables the next one opens a table with probability a / (a + s - d t), a = (strength + d (other + t)) prior.
    The work is a few operations for each customer, in arrays over dishes or, for the few dishes of most customers, over customers; the result is the same.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    order = np.flatnonzero(customers > 1)
    order = order[np.argsort(-customers[order], kind="stable")]
    many, p, o, k = customers[order], prior[order], other[order].astype(np.float64), key[order]
    t, s = np.ones(len(order)), 1
    while len(many) and s < many[0]:
        n = np.searchsorted(-many, -s)
        if n < FEW and s >= LONG:
            break
        new = (strength + discount * (o[:n] + t[:n])) * p[:n]
        t[:n] += new * _odds(k[:n], s) > s - discount * t[:n]
        s += 1
    for i in range(np.searchsorted(-many, -s)):
        for a in range(s, int(many[i]), BLOCK):
            at = np.arange(a, min(int(many[i]), a + BLOCK))
            odds, j = _odds(k[i : i + 1], at), 0
            while j < len(at):
                new = (strength + discount * (o[i] + t[i])) * p[i]
                # up to about twice the gap that is to be expected
                end = j + 16 + int(min(BLOCK, 2 * a / new))
                opens = new * odds[j:end] > at[j:end] - discount * t[i]
                first = int(opens.argmax())
                t[i] += opens[first]
                j = j + first + 1 if opens[first] else end
    tables[order] = t.astype(np.int64)
    return tables


def _among(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Whether values are among few ascending ones."""
    if not len(few):
        return np.zeros(len(values), bool)
    return few[np.minimum(np.searchsorted(few, values), len(few) - 1)] == values


class Shared:
    """What all tasks know: the hot contexts (ascending), the words that are written as numbers, and the hot pairs with the number of groups that each is dealt over."""

    def __init__(self, hot: np.ndarray, coded: np.ndarray, pairs: np.ndarray, parts: np.ndarray) -> None:
        """pairs: (n, 2), ascending by their keys."""
        self.hot, self.coded, self.parts = hot, coded, parts
        keys = _pair_keys(pairs[:, 0], pairs[:, 1])
        order = np.argsort(keys)
        self.keys, self.pairs, self.parts = keys[order], pairs[order], parts[order]

    def pair_at(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Places of pairs among the hot ones; -1 for others."""
        if not len(self.keys):
            return np.full(len(context), -1)
        at = np.minimum(np.searchsorted(self.keys, _pair_keys(context, token)), len(self.keys) - 1)
        return np.where((self.pairs[at, 0] == context) & (self.pairs[at, 1] == token), at, -1)


def _pair_keys(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + token)


def dealt(context: np.ndarray, token: np.ndarray, batch: int, shared: Shared, groups: int) -> np.ndarray:
    """The groups of a batch's tokens: by context, by pair after a hot context, by pair and batch for a hot pair."""
    group = mix(np.where(_among(context, shared.hot), context * np.uint64(0x9E3779B97F4A7C15) + token, context))
    pair = shared.pair_at(context, token)
    often = np.flatnonzero(pair >= 0)
    if len(often):
        part = mix(np.full(1, batch, np.uint64)) % shared.parts[pair[often]].astype(np.uint64)
        group[often] = mix(shared.keys[pair[often]] + part * np.uint64(0xC2B2AE3D27D4EB4F))
    return (group % np.uint64(groups)).astype(np.int64)


class Pairs:
    """The words of a group of contexts, which of them its tokens hold, and its pairs in training with their customers: all that the rounds need."""

    def __init__(self, words: np.ndarray, asked: np.ndarray, pairs: np.ndarray, customers: np.ndarray, shared: Shared) -> None:
        """words, pairs: ascending; asked: places of the words with an answer, ascending."""
        self.words, self.asked, self.pairs, self.customers = words, asked, pairs, customers
        self.pair_context, self.pair_word = pairs >> 32, pairs & 0xFFFFFFFF
        self.is_hot = _among(words, shared.hot)
        self.hot_pair = shared.pair_at(words[self.pair_context], words[self.pair_word])
        #: Pairs whose tables this group counts.
        self.mine = self.hot_pair < 0

    def packed(self, shared: Shared) -> list[bytes]:
        ranked = np.argsort(shared.coded)
        at = np.minimum(np.searchsorted(shared.coded[ranked], self.words), max(0, len(ranked) - 1))
        coded = shared.coded[ranked[at]] == self.words if len(ranked) else np.zeros(len(self.words), bool)
        met, asked = np.zeros(len(ranked), bool), np.zeros(len(self.words), bool)
        met[ranked[at[coded]]] = True
        asked[self.asked] = True
        rare = _planes(np.diff(self.words[~coded], prepend=np.uint64(0)), 7)
        return [_squeeze(met.tobytes()), rare, _squeeze(asked.tobytes()), *map(_ints, (np.diff(self.pair_context, prepend=0), self.pair_word, self.customers))]

    @classmethod
    def unpacked(cls, held: list[bytes], shared: Shared) -> Pairs:
        release()
        words = _distinct(np.concatenate([shared.coded[_expand(held[0], bool)], np.cumsum(_unplanes(held[1], 7), dtype=np.uint64)]))
        context, word, customers = map(_from_ints, held[3:])
        return cls(words, np.flatnonzero(_expand(held[2], bool)), np.cumsum(context) << 32 | word, customers, shared)

    def of_context(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.pair_context, weights=weights, minlength=len(self.words)).astype(np.int64)

    def of_word(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.pair_word, weights=weights, minlength=len(self.words)).astype(np.int64)[self.asked]

    def sweep(self, tables: np.ndarray, prior: np.ndarray, total: np.ndarray, turn: int) -> np.ndarray:
        """One sweep over all restaurants. total: tables of each context, over all groups."""
        key = _keys(self.words[self.pair_context], self.words[self.pair_word], turn)
        return seat(self.customers, prior[self.pair_word], total[self.pair_context] - tables, DISCOUNT, STRENGTH, key)


class Group(Pairs):
    """All tokens of a group of contexts besides, as (pair, times) in numbers of distinct words, batch after batch, and their documents by batch.

    What it takes depends on its tokens alone: a batch adds no table of the frequent words and no list of its documents, however many batches the corpus has.
    """

    def __init__(self, part: pa.Table, shared: Shared) -> None:
        release()
        f, column = len(shared.coded), lambda c: part[c].to_pylist()
        rare = [np.cumsum(_unplanes(x, 7), dtype=np.uint64) for x in column("words")]
        contexts = [np.cumsum(_from_ints(x)).astype(np.uint32) for x in column("contexts")]
        tokens = [_from_ints(x).astype(np.uint32) for x in column("tokens")]
        met = np.zeros(f, bool)
        for x in (*contexts, *tokens):
            met[x[x < f]] = True
        words = _distinct(np.concatenate([shared.coded[met], *rare]))
        # places of the frequent words, and behind them those of one batch's others
        place = np.zeros(f + max(map(len, rare), default=0), np.int64)
        place[np.flatnonzero(met)] = np.searchsorted(words, shared.coded[met])
        self.begins = np.cumsum([0, *map(len, tokens)])
        self.pair = np.empty(self.begins[-1], np.int64)
        for a, b, r, c, t in zip(self.begins[:-1], self.begins[1:], rare, contexts, tokens, strict=True):
            place[f : f + len(r)] = np.searchsorted(words, r)
            self.pair[a:b] = place[c] << 32 | place[t]
        del rare, contexts, tokens, place
        self.times = np.concatenate([_from_ints(x).astype(np.uint32) for x in column("times")])
        self.docs = [_from_ints(x).astype(np.uint32) for x in column("docs")]
        train = np.concatenate([d < n for d, n in zip(self.docs, column("trained"), strict=True)])
        pair = np.sort(self.pair[train])
        begins = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, int)
        pairs, customers = pair[begins], np.diff(np.r_[begins, len(pair)])
        more = np.flatnonzero(train & (self.times > 1))
        np.add.at(customers, np.searchsorted(pairs, self.pair[more]), self.times[more].astype(np.int64) - 1)
        del pair, begins, train, more
        if len(shared.keys):  # a hot pair is one of training here even if other groups have all of that
            at = np.minimum(np.searchsorted(words, shared.pairs), max(0, len(words) - 1)).astype(np.int64)
            here = (words[at] == shared.pairs).all(axis=1) if len(words) else np.zeros(len(at), bool)
            hot = np.sort(at[here, 0] << 32 | at[here, 1])
            also = np.setdiff1d(self.pair[_among(self.pair, hot)], pairs)
            at = np.searchsorted(pairs, also)
            pairs, customers = np.insert(pairs, at, also), np.insert(customers, at, 0)
        super().__init__(words, np.flatnonzero(np.bincount(self.pair & 0xFFFFFFFF, minlength=len(words))), pairs, customers, shared)


def _frequent(rows: DataFrame, groups: int) -> Shared:
    """Words and pairs that hold more than HOT of a group's share of all tokens (about groups / HOT of either at most), and the most frequent words. They only steer the dealing and writing.

    Counted over all tokens; a batch reports its number of tokens, the words with REPORTED occurrences or half of that share in it, and pairs with half of that share.
    """
    share = HOT / groups

    def frequent(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, texts in _batches(parts):
            tokens, _ = _tokens(texts)
            ranked = np.sort(tokens)
            begins = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
            words, n = ranked[begins], np.diff(np.r_[begins, len(ranked)])
            often = n >= share / 2 * len(tokens)
            # a pair is frequent only if both of its words are
            few = words[often]
            there = _among(tokens, few)
            both = np.flatnonzero(there & np.r_[_among(END.reshape(1), few), there[:-1]])
            after = np.searchsorted(few, np.where(both > 0, tokens[both - 1], END))
            pairs, k = np.unique(after * max(1, len(few)) + np.searchsorted(few, tokens[both]), return_counts=True)
            pairs, k = pairs[k >= share / 2 * len(tokens)], k[k >= share / 2 * len(tokens)]
            pairs = np.stack([few[pairs // max(1, len(few))], few[pairs % max(1, len(few))]], 1) if len(pairs) else np.zeros((0, 2), np.uint64)
            told = often | (n >= REPORTED)
            # the number of tokens stands under -1, which is no word; a word alone has -1 for the other
            one = [np.append(words[told].astype(np.int64), -1), pairs[:, 0].astype(np.int64)]
            other = [np.full(told.sum() + 1, -1), pairs[:, 1].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(np.concatenate(other)), pa.array(np.concatenate([np.append(n[told], len(tokens)), k]).astype(np.int64))], ["word", "other", "n"])

    counted = shared_table(rows.mapInArrow(releasing(frequent), "word long, other long, n long").groupBy("word", "other").agg(F.sum("n").alias("n")), "frequent")
    whole = counted.where(F.col("word") == -1).first()
    if whole is None:
        return Shared(np.array([int(END)], np.uint64), np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
    words = counted.where((F.col("word") >= 0) & (F.col("other") < 0))
    found = words.where(F.col("n") >= share * whole["n"]).select("word").toPandas()["word"].to_numpy()
    pairs = counted.where((F.col("other") >= 0) & (F.col("n") >= share * whole["n"])).select("word", "other", "n").toPandas()
    # as many doublings of the number of occurrences as leave CODES words
    numbers = words.agg(*[F.count_if(F.col("n") >= 1 << k).alias(f"n{k}") for k in range(62)]).first()
    least = 1 << next((k for k in range(62) if numbers[k] <= CODES), 62)
    coded = words.where(F.col("n") >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])["word"].to_numpy(np.int64)
    parts = np.ceil(pairs["n"].to_numpy() / (share * whole["n"])).astype(np.int64)
    return Shared(np.unique(np.append(found.astype(np.uint64), END)), coded.astype(np.uint64), pairs[["word", "other"]].to_numpy(np.int64).astype(np.uint64), parts)


def _hot_words(rows: DataFrame, groups: int) -> np.ndarray:
    return _frequent(rows, groups).hot


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.table({n: pa.array(c, kinds[t]) for n, t, c in zip(names, types, columns, strict=True)})


def _ints(values: np.ndarray) -> bytes:
    """Numbers from 0, in as many byte planes as the largest needs; the first byte is their number."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + _planes(values, width)


def _from_ints(data: bytes) -> np.ndarray:
    return _unplanes(data[1:], data[0]).view(np.int64)


def _joined(part: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *map(_from_ints, part[column].to_pylist())])


def _summed(part: pa.Table, column: str) -> bytes:
    """The sum of a column's arrays, of one length."""
    return _ints(np.sum([_from_ints(x) for x in part[column].to_pylist()], axis=0))


def _fixed(values: np.ndarray) -> tuple[int, bytes]:
    """Sums of logarithms (0 or below) as whole numbers of as many binary places as they have room for."""
    places = min(PLACES, 62 - max(1, int(-values.min(initial=0)).bit_length()))
    return places, _ints(np.rint(-values * 2.0**places).astype(np.int64))


#: What groups (g) tell slices of words (q), and what these answer; a group's own state travels along under a negative q.
FIRST = "g long, q long, words binary, counts binary, dishes binary, hot_n binary, hot_m binary, pair_n binary"
TOLD = "g long, q long, tables binary, own binary, hot_m binary, types long, grand long, state array<binary>"
ANSWER = "g long, q long, customers binary, dishes binary, own binary, hot_n binary, hot_m binary, pair_n binary, pair_at binary, tokens long, types long, parents long, grand long, state array<binary>"


def _slice(part: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A slice's words, which of them each group has told (one behind the other), and the same for each group."""
    release()
    words = [np.cumsum(_unplanes(x, 7), dtype=np.uint64) for x in part["words"].to_pylist()]
    found, which = np.unique(np.concatenate(words), return_inverse=True)
    return found, which, np.split(which, np.cumsum([len(w) for w in words])[:-1])


def count_slice(part: pa.Table) -> pa.Table:
    """Corpus-wide training counts (64 bits, as all totals) and dishes of a slice's words, customers and dishes of its hot contexts, and customers of its hot pairs with the group that counts their tables."""
    part = part.sort_by("g")
    found, which, ranks = _slice(part)
    counts = np.bincount(which, weights=_joined(part, "counts"), minlength=len(found)).astype(np.int64)
    dishes = np.bincount(which, weights=_joined(part, "dishes"), minlength=len(found)).astype(np.int64)
    g = part["g"].to_numpy()
    customers = np.array([_from_ints(x) for x in part["pair_n"].to_pylist()])
    first = g[np.argmax(customers > 0, axis=0)] if customers.size else np.zeros(0, np.int64)
    same = None, _summed(part, "hot_n"), _summed(part, "hot_m"), _summed(part, "pair_n"), _ints(first), int(counts.sum()), int((counts > 0).sum()), None, None, None
    return _table(ANSWER, [(i, q, _ints(counts[r]), _ints(dishes[r]), *same) for i, q, r in zip(g.tolist(), part["q"].to_pylist(), ranks, strict=True)])


def seat_slice(first: pa.Table, part: pa.Table, turn: int) -> pa.Table:
    """The parent's customers (beyond one for each dish) and tables for a slice's words, and the tables of its hot contexts. first: what groups told in the beginning."""
    if not first.num_rows:
        return _table(ANSWER, [(g, q, *[None] * 11, state) for g, q, state in zip(*(part[c].to_pylist() for c in ("g", "q", "state")), strict=True)])
    first, part = first.sort_by("g"), part.sort_by("g")
    found, which, ranks = _slice(first)
    dishes = np.bincount(which, weights=_joined(first, "dishes"), minlength=len(found)).astype(np.int64)
    more = np.bincount(which, weights=_joined(part, "tables"), minlength=len(found)).astype(np.int64)
    own = np.zeros(len(found), np.int64)
    own[which] = _joined(part, "own")
    types, grand = (part[c][0].as_py() for c in ("types", "grand"))
    own = seat(dishes + more, np.full(len(own), 1 / (types + 1)), grand - own, PARENT_DISCOUNT, PARENT_STRENGTH, _keys(found, turn, 1))
    same = None, _summed(part, "hot_m"), None, None, None, None, int((dishes + more).sum()), int(own.sum()), None
    return _table(ANSWER, [(g, q, _ints(more[r]), None, _ints(own[r]), *same) for g, q, r in zip(*(part[c].to_pylist() for c in ("g", "q")), ranks, strict=True)])


class Seating:
    """A group's seating after the answers of a round: tables of its pairs, what its words have in the parent, and the samples so far."""

    def __init__(self, g: int, group: Pairs, right: pa.Table, turn: int, shared: Shared) -> None:
        self.group = group
        answers = right.filter(pa.compute.greater_equal(right["q"], 0)).sort_by("q")
        sums = lambda c: sum(answers[c].to_pylist())
        customers, hot_m = _joined(answers, "customers"), _joined(answers, "hot_m")
        self.samples: list[np.ndarray] = []
        if turn == 0:
            self.tokens, self.types = sums("tokens"), sums("types")
            self.counts, self.dishes, self.hot_n, self.pair_n, self.pair_at = customers, *(_joined(answers, c) for c in ("dishes", "hot_n", "pair_n", "pair_at"))
            # the dishes of the hot pairs, which no group has counted
            hot_m = hot_m + np.bincount(np.searchsorted(shared.hot, shared.pairs[self.pair_n > 0, 0]), minlength=len(shared.hot))
            self.of_pairs(g)
            self.tables, self.summed = np.minimum(group.customers, 1), np.zeros(len(group.pairs), np.int64)
            self.own, self.grand = np.minimum(customers, 1), self.types
            self.prior = np.full(len(group.words), 1 / (self.tokens + self.types + 1))
            self.prior[group.asked] = (customers + 1) / (self.tokens + self.types + 1)
        else:
            (state,) = right.filter(pa.compute.less(right["q"], 0))["state"].to_pylist()
            (self.tokens, self.types), self.counts, self.dishes, self.hot_n, self.pair_n, self.pair_at, self.tables, self.summed, *held = map(_from_ints, state)
            self.of_pairs(g)
            self.samples = [x + b for x, b in zip(held, self.bases() * (len(held) // 4), strict=True)]
            customers = self.dishes + customers
            self.own, self.grand = _joined(answers, "own"), sums("grand")
            self.prior = self.of_parent(customers, self.own, sums("parents"), self.grand)
        self.total = self.spread(hot_m, group.of_context(self.tables), shared.hot)
        if turn > BURN:
            self.summed = self.summed + self.tables
            self.samples += [self.total, customers, self.own, np.array([sums("parents"), self.grand])]

    def of_pairs(self, g: int) -> None:
        """Gives the group all customers of its hot pairs, and those to count that are its to count."""
        group = self.group
        hot = np.flatnonzero(group.hot_pair >= 0)
        group.customers[hot] = self.pair_n[group.hot_pair[hot]]
        group.mine[hot] = self.pair_at[group.hot_pair[hot]] == g

    def of_parent(self, customers: np.ndarray, own: np.ndarray, parents: int, grand: int) -> np.ndarray:
        """The parent's probabilities of the group's words."""
        unseen = (PARENT_STRENGTH + PARENT_DISCOUNT * grand) / (self.types + 1)
        prior = np.full(len(self.group.words), unseen / (PARENT_STRENGTH + parents))
        prior[self.group.asked] = (customers - PARENT_DISCOUNT * own + unseen) / (PARENT_STRENGTH + parents)
        return prior

    def spread(self, values: np.ndarray, start: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """start, with the values of all hot words at those that the group has."""
        out = start.copy()
        here = np.flatnonzero(self.group.is_hot)
        out[here] = values[np.searchsorted(hot, self.group.words[here])]
        return out

    def bases(self) -> list[np.ndarray]:
        """What most numbers of a sample equal: a table for each dish, a customer of the parent for each dish, one table of a word. No sample has fewer."""
        return [self.group.of_context(np.minimum(self.group.customers, 1) * self.group.mine), self.dishes, np.minimum(self.counts, 1), np.zeros(2, np.int64)]

    def state(self) -> list[bytes]:
        """All of it but what the group's tokens and the answers tell; samples as differences, which are few and small."""
        bases = self.bases()
        apart = [x - bases[i % 4] for i, x in enumerate(self.samples)]
        return [_ints(x) for x in (np.array([self.tokens, self.types]), self.counts, self.dishes, self.hot_n, self.pair_n, self.pair_at, self.tables, self.summed, *apart)]

    def more_tables(self) -> np.ndarray:
        """Customers that the pairs give the parent's words beyond one for each ordinary dish."""
        group = self.group
        return group.of_word((self.tables - np.where(group.hot_pair < 0, np.minimum(group.customers, 1), 0)) * group.mine)

    def chances(self, hot: np.ndarray) -> np.ndarray:
        """The predictive probability of each token, averaged over the samples."""
        group = self.group
        discounted = group.customers - DISCOUNT * self.summed / SAMPLES
        back = [(STRENGTH + DISCOUNT * total, self.of_parent(customers, tables, parents, grand) / SAMPLES) for total, customers, tables, (parents, grand) in zip(*(self.samples[i::4] for i in range(4)), strict=True)]
        of_context = STRENGTH + self.spread(self.hot_n, group.of_context(group.customers), hot)
        out = np.empty(len(group.pair))
        for a in range(0, len(out), STRETCH):
            pair = group.pair[a : a + STRETCH]
            context, token = pair >> 32, pair & 0xFFFFFFFF
            at = np.searchsorted(group.pairs, pair)
            at[at == len(group.pairs)] = 0
            seen = group.pairs[at] == pair if len(group.pairs) else np.zeros(len(pair), bool)
            own = np.zeros(len(pair))
            own[seen] = discounted[at[seen]]
            for strength, parent in back:
                own += strength[context] * parent[token]
            out[a : a + STRETCH] = own / of_context[context]
        return out


def score(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of documents (doc_id, text)."""
    spark = documents.sparkSession
    chars = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(partitions(spark), chars // GROUP_CHARS)
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder(F.col("doc_id"), FOLDS) != 0).alias("train"))
    shared = _frequent(rows, groups)
    sent = spark.sparkContext.broadcast(shared)  # CODES words at most, and four contexts and pairs for each group at most
    slices = max(SLICES, groups // GROUPS_EACH)
    bounds = np.array([(q << BITS) // slices for q in range(slices + 1)], np.uint64)

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = sent.value
        ranked = np.argsort(shared.coded)
        by_word = shared.coded[ranked]
        for number, ids, train, texts in _batches(parts):
            # documents for training come first, so that their number tells which they are
            order = np.argsort(~train, kind="stable")
            ids, texts, trained = ids.take(pa.array(order)), [texts[i] for i in order], int(train.sum())
            tokens, n = _tokens(texts)
            context = np.concatenate([[END], tokens[:-1]])
            words, t = np.unique(tokens, return_inverse=True)
            # a word's number among the coded ones, or among the batch's others behind these
            code = np.full(len(words), -1)
            if len(by_word):
                at = np.minimum(np.searchsorted(by_word, words), len(by_word) - 1)
                code = np.where(by_word[at] == words, ranked[at], -1)
            others, f = words[code < 0], len(by_word)
            code[code < 0] = f + np.arange(len(others))
            c = np.concatenate([[np.searchsorted(words, END)], t[:-1]])
            group = dealt(context, tokens, int(number[0]), shared, groups)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.argsort(group.astype(np.uint16) if groups < 1 << 16 else group, kind="stable")  # short numbers sort by radix
            ends = np.searchsorted(group[order], np.arange(groups + 1))
            made = []
            for g in range(groups):
                at = order[ends[g] : ends[g + 1]]
                if len(at):
                    x, y, d = code[c[at]], code[t[at]], doc[at]
                    used = _distinct(np.concatenate([x[x >= f], y[y >= f]]))
                    x[x >= f], y[y >= f] = f + np.searchsorted(used, x[x >= f]), f + np.searchsorted(used, y[y >= f])
                    key = x << 32 | y
                    by = np.argsort(key, kind="stable")
                    key, d = key[by], d[by]
                    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (d[1:] != d[:-1])])
                    key, d, times = key[first], d[first], np.diff(np.r_[first, len(d)])
                    lead = not made
                    made.append((g, int(number[0]), _planes(np.diff(others[used - f], prepend=np.uint64(0)), 7), _ints(np.diff(key >> 32, prepend=0)), _ints(key & 0xFFFFFFFF), _ints(d), _ints(times), trained, ids if lead else None, _planes(n, 4) if lead else None))
            columns = list(zip(*made, strict=True))
            id_lists = pa.array([x.to_pylist() if x is not None else None for x in columns[8]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(x, pa.binary()) for x in columns[2:7]), pa.array(columns[7], pa.int64()), id_lists, pa.array(columns[9], pa.binary())], ["g", "batch", "words", "contexts", "tokens", "docs", "times", "trained", "ids", "sizes"])

    packed = rows.mapInArrow(releasing(pack), "g long, batch long, words binary, contexts binary, tokens binary, docs binary, times binary, trained long, ids array<long>, sizes binary")

    hot_cut, pair_cut = np.searchsorted(shared.hot, bounds), (np.arange(slices + 1) * len(shared.keys)) // slices

    def of_hot(group: Pairs, values: np.ndarray) -> np.ndarray:
        """Values of the group's words for all hot words, 0 for those that it lacks."""
        hot = sent.value.hot
        out = np.zeros(len(hot), values.dtype)
        here = np.flatnonzero(group.is_hot)
        out[np.searchsorted(hot, group.words[here])] = values[here]
        return out

    def distil(part: pa.Table) -> pa.Table:
        group = Group(part.sort_by("batch"), sent.value)
        return _table("g long, held array<binary>", [(part["g"][0].as_py(), group.packed(sent.value))])

    def ask(part: pa.Table) -> pa.Table:
        """A group's words with their training counts and dishes, its hot contexts' customers and dishes and its hot pairs' customers, for every slice of words (q), as each slice's sums go to every group."""
        g = part["g"][0].as_py()
        group = Pairs.unpacked(part["held"][0].as_py(), sent.value)
        asked, counts = group.words[group.asked], group.of_word(group.customers)
        single = np.minimum(group.customers, 1) * group.mine
        dishes = group.of_word(single)
        cut = np.searchsorted(asked, bounds)
        hots = [of_hot(group, group.of_context(x)) for x in (group.customers, single)]
        pairs = np.zeros(len(sent.value.keys), np.int64)
        pairs[group.hot_pair[group.hot_pair >= 0]] = group.customers[group.hot_pair >= 0]
        cuts = zip(cut[:-1], cut[1:], hot_cut[:-1], hot_cut[1:], pair_cut[:-1], pair_cut[1:], strict=True)
        return _table(FIRST, [(g, q, _planes(np.diff(asked[i:j], prepend=np.uint64(0)), 7), _ints(counts[i:j]), _ints(dishes[i:j]), *(_ints(x[k:m]) for x in hots), _ints(pairs[a:b])) for q, (i, j, k, m, a, b) in enumerate(cuts)])

    def tell(turn: int):  # noqa: ANN202
        def seated(left: pa.Table, right: pa.Table) -> pa.Table:
            """The round's tables of each slice's words and hot contexts, and the group's state (q below 0)."""
            if not left.num_rows:
                return _table(TOLD, [])
            g, shared = left["g"][0].as_py(), sent.value
            group = Pairs.unpacked(left["held"][0].as_py(), shared)
            now = Seating(g, group, right, turn, shared)
            now.tables = group.sweep(now.tables, now.prior, now.total, turn)
            held = now.more_tables()
            cut = np.searchsorted(group.words[group.asked], bounds)
            hot_m = of_hot(group, group.of_context(now.tables * group.mine))
            rows = [(g, q, _ints(held[cut[q] : cut[q + 1]]), _ints(now.own[cut[q] : cut[q + 1]]), _ints(hot_m[hot_cut[q] : hot_cut[q + 1]]), int(now.types), int(now.grand), None) for q in range(slices)]
            return _table(TOLD, [*rows, (g, -1 - g, *[None] * 5, now.state())])

        return seated

    by_group = lambda left, right, made, schema: left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(made, schema)
    # tokens are read twice, for their pairs and in the end; the rounds read the pairs
    pairs = packed.groupBy("g").applyInArrow(distil, "g long, held array<binary>")
    first = pairs.groupBy("g").applyInArrow(ask, FIRST)
    answers = first.groupBy("q").applyInArrow(count_slice, ANSWER)
    for turn in range(BURN + SAMPLES):
        # a function of its own for each round
        told = by_group(pairs, answers, tell(turn), TOLD)
        answers = first.groupBy("q").cogroup(told.groupBy("q")).applyInArrow((lambda turn: lambda left, right: seat_slice(left, right, turn))(turn), ANSWER)

    def predict(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums of log10 probabilities for each batch's documents."""
        names = ["batch", "train_tokens", "ids", "sizes", "trained", "docs", "base_places", "base", "score_places", "score", "known"]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), *[pa.binary()] * 2]
        if not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, types, strict=True)})
        left, shared = left.sort_by("batch"), sent.value
        group = Group(left, shared)
        now = Seating(left["g"][0].as_py(), group, right, BURN + SAMPLES, shared)
        n, v, counts = int(now.tokens), int(now.types), now.counts
        base = np.zeros(len(group.words))
        base[group.asked] = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
        known = np.zeros(len(group.words), bool)
        known[group.asked] = counts > 0
        chance = now.chances(shared.hot)
        made = []
        for a, b, docs in zip(group.begins[:-1], group.begins[1:], group.docs, strict=True):
            token, times = group.pair[a:b] & 0xFFFFFFFF, group.times[a:b]
            there = np.flatnonzero(np.bincount(docs))
            of = lambda x: np.bincount(docs, weights=x * times)[there]  # noqa: B023, E731
            made.append((_planes(np.diff(there, prepend=0), 4), *_fixed(of(base[token])), *_fixed(of(np.log10(chance[a:b]))), _planes(of(known[token]).astype(np.int64), 4)))
        values = [left["batch"], pa.array([n] * len(made), pa.int64()), left["ids"], left["sizes"], left["trained"], *(pa.array(x, t) for x, t in zip(zip(*made, strict=True), types[5:], strict=True))]
        return pa.table({c: x.cast(t) for c, x, t in zip(names, values, types, strict=True)})

    parts = by_group(packed, answers, predict, "batch long, train_tokens long, ids array<long>, sizes binary, trained long, docs binary, base_places long, base binary, score_places long, score binary, known binary")

    def gather(part: pa.Table) -> pa.Table:
        part = part.to_pylist()
        lead = next(p for p in part if p["ids"] is not None)
        size = len(lead["ids"])
        out = {c: np.zeros(size) for c in ("base", "score", "known")}
        for p in part:
            at = np.cumsum(_unplanes(p["docs"], 4)).astype(np.int64)
            for c in ("base", "score"):
                out[c][at] -= _from_ints(p[c]) * 2.0 ** -p[f"{c}_places"]
            out["known"][at] += _unplanes(p["known"], 4)
        return pa.table({
            "doc_id": pa.array(lead["ids"], pa.int64()), "held_out": pa.array(np.arange(size) >= lead["trained"]), "n_tokens": pa.array(_unplanes(lead["sizes"], 4).astype(np.int64)), "n_known": pa.array(out["known"].astype(np.int64)),
            "train_tokens": pa.array(np.full(size, lead["train_tokens"] or 0, np.int64)), "base_score": pa.array(out["base"]), "score": pa.array(out["score"]),
        })

    return parts.groupBy("batch").applyInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, perplexity, base_perplexity of scored documents."""
    return scored.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"), F.pow(F.lit(10.0), -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity"))
