"""A unigram view of a SentencePiece vocabulary, and the best segmentation of one short stretch of text.

No tokenizer is trained: pieces come from a model file in their order, and a piece of rank r weighs -ln(r + 2), rounded to 1/256 so
that sums are exact. A character without a piece of its own is unknown, weighs the lowest weight less 10, and falls back to
its UTF-8 bytes. Spaces become U+2581; a text that is not empty gets one in front.

Ties are settled as SentencePiece's unigram encoder does: at each end the pieces are tried from the earliest start, then the unknown
character, and only a higher sum replaces what is held.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Weights are whole numbers of this.
UNIT = 1 / 256
PENALTY = 10.0
NONE = -(1 << 60)
#: Stretches that a worker keeps of each generation, and the characters of the longest one that is kept: together a bound in bytes.
KEPT, KEPT_CHARS = 50_000, 32
#: A stretch ends before a space that follows another character, and around a line break: no piece reaches across.
STRETCH = re.compile("▁*[^▁\\n]+|▁+|\\n")


class Kept(dict):
    """What `make` gives for stretches. Two generations of at most `most` entries each: what is met again outlives the rest.

    Stretches of more than KEPT_CHARS characters are made each time.
    """

    def __init__(self, make, most: int) -> None:
        self.make, self.most, self.old = make, most, {}

    def clear(self) -> None:
        super().clear()
        self.old = {}

    def __missing__(self, stretch: str):
        if len(stretch) > KEPT_CHARS:
            return self.make(stretch)
        if len(self) >= self.most:
            recent = dict(self)
            self.clear()
            self.old = recent
        found = self.old.get(stretch)
        if found is None:
            found = self.make(stretch)
        self[stretch] = found
        return found


@dataclass
class Unigram:
    """ids, pieces and whole-number weights of the ordinary pieces, and the ids of the 256 bytes."""

    pieces: list[str]
    ids: list[int]
    weights: list[int]
    byte_ids: list[int]
    size: int
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces))
        if bad := [p for p in self.pieces if SPACE in p.lstrip(SPACE) or "\n" in p]:
            raise ValueError(f"pieces reach across a space or line break: {bad[:3]}")

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for piece, i, w in zip(self.pieces, self.ids, self.weights, strict=True):
            found.add_word(piece, (len(piece), w, i))
        found.make_automaton()
        return found

    @cached_property
    def singles(self) -> frozenset[str]:
        return frozenset(p for p in self.pieces if len(p) == 1)

    @cached_property
    def unknown(self) -> int:
        return min(self.weights) - round(PENALTY / UNIT)

    def matches(self, text: str) -> list[list[tuple[int, int, int]]]:
        """For each end (exclusive) the (length, weight, id) of the pieces that end there, longest first, then an unknown character (id -1)."""
        ends: list[list[tuple[int, int, int]]] = [[] for _ in range(len(text) + 1)]
        for last, piece in self.automaton.iter(text):
            ends[last + 1].append(piece)
        for i, c in enumerate(text):
            if c not in self.singles:
                ends[i + 1].append((1, self.unknown, -1))
        return ends

    def count(self, stretch: str) -> int:
        """Number of pieces of the best segmentation; sums and counts are carried side by side, no segmentation is built."""
        if not self.singles.issuperset(stretch):
            return self._count_any(stretch)
        # each character is a piece, so every end is met, in order, with its longest piece first
        best, n, now, top, pieces = [0], [0], 0, NONE, 0
        for last, (length, weight, _) in self.automaton.iter(stretch):
            if last != now:
                best.append(top)
                n.append(pieces)
                now, top = last, NONE
            at = last + 1 - length
            if (total := best[at] + weight) > top:
                top, pieces = total, n[at] + 1
        return pieces

    def _count_any(self, stretch: str) -> int:
        """count() for stretches with unknown characters, each of which counts as its bytes."""
        best, n = [0], [0]
        for i, pieces in enumerate(self.matches(stretch)[1:]):
            top, count = None, 0
            for length, weight, piece in pieces:
                total = best[i + 1 - length] + weight
                if top is None or total > top:
                    top, count = total, n[i + 1 - length] + (1 if piece >= 0 else len(stretch[i].encode()))
            best.append(top)
            n.append(count)
        return n[-1]

    def encode(self, stretch: str) -> list[int]:
        """Ids of the best segmentation."""
        if not self.singles.issuperset(stretch):
            return self._encode_any(stretch)
        best, lengths, ids, now, top, size, piece = [0], [0], [0], 0, NONE, 0, 0
        for last, (length, weight, i) in self.automaton.iter(stretch):
            if last != now:
                best.append(top)
                lengths.append(size)
                ids.append(piece)
                now, top = last, NONE
            if (total := best[last + 1 - length] + weight) > top:
                top, size, piece = total, length, i
        lengths.append(size)
        ids.append(piece)
        out, at = [], len(stretch)
        while at:
            out.append(ids[at])
            at -= lengths[at]
        out.reverse()
        return out

    def _encode_any(self, stretch: str) -> list[int]:
        """encode() for stretches with unknown characters."""
        best, back = [0], [(0, 0)]
        for i, pieces in enumerate(self.matches(stretch)[1:]):
            top, how = None, None
            for length, weight, piece in pieces:
                total = best[i + 1 - length] + weight
                if top is None or total > top:
                    top, how = total, (length, piece)
            best.append(top)
            back.append(how)
        out, at = [], len(stretch)
        while at:
            length, piece = back[at]
            out += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(stretch[at - 1].encode())]
            at -= length
        return out[::-1]

    def __getstate__(self) -> dict:
        """The fields alone: what is derived or kept is made anew by each worker."""
        return {k: self.__dict__[k] for k in ("pieces", "ids", "weights", "byte_ids", "size", "longest")}

    @cached_property
    def known_counts(self) -> Kept:
        return Kept(self.count, KEPT)

    @cached_property
    def known_ids(self) -> Kept:
        """Ids as bytes of 32-bit numbers."""
        return Kept(lambda stretch: array("i", self.encode(stretch)).tobytes(), KEPT)

    @cached_property
    def spelled(self) -> list[bytes]:
        """The bytes that each id stands for."""
        out = [b""] * self.size
        for piece, i in zip(self.pieces, self.ids, strict=True):
            out[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out


def load(path: str = MODEL) -> Unigram:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    bytes_ = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)}
    # runs of spaces have no rank of their own in such a file: they stand last
    ids = sorted((i for i in range(size) if i not in special), key=lambda i: (model.get_score(i) <= -1e6, -model.get_score(i), i))
    weights = [-round(math.log(r + 2) / UNIT) for r in range(len(ids))]
    return Unigram([model.id_to_piece(i) for i in ids], ids, weights, bytes_, size)


def escaped(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""
