"""The piece table of a SentencePiece model file, and units: parts of a text between which no piece reaches.

The operators read a model as a unigram model: a text is cut into the pieces
whose scores add up to most, summed exactly. No piece has the two characters
at a unit boundary next to each other, so each unit can be cut alone, and equal
units once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .shared import mixed, powers

UNKNOWN_PENALTY = 10.0
#: Scores up to this are no log probabilities but say that a piece was added by hand.
PLACEHOLDER = -1e8
_B = np.uint64(0x9E3779B97F4A7C15)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return out, at


def _fields(data: bytes):
    """(field number, value) of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            n, at = _varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class PieceTable:
    """Pieces and scores of a model file, and which two characters may stand together in a piece."""

    def __init__(self, path: str):
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        self.names: list[str] = []
        self.unknown = 0
        with open(path, "rb") as f:
            message = f.read()
        for number, value in _fields(message):
            if number != 1:  # the pieces; normalisation is the identity with a blank put before the text
                continue
            own = dict(_fields(value))
            text, score, kind = own.get(1, b"").decode(), float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]), own.get(3, 1)
            i = len(self.names)
            self.names.append(text)
            if kind == 6:
                self.bytes[int(text[3:5], 16)] = i
            elif kind == 2:
                self.unknown = i
            elif kind in (1, 4):
                self.pieces[text] = (i, score)
        # Beside such a score all others would be lost in rounding: these pieces come just after the least other.
        least = min((s for _, s in self.pieces.values() if s > PLACEHOLDER), default=0.0)
        self.pieces = {p: (i, s if s > PLACEHOLDER else least - 1) for p, (i, s) in self.pieces.items()}
        self.unknown_score = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.pieces))
        chars = sorted({c for p in self.pieces if len(p) > 1 for c in p})
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.together = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in self.pieces:
            k = self.classes[[ord(c) for c in p]]
            self.together[k[:-1], k[1:]] = True

    def units(self, texts: list[str | None]):
        """(code points of the texts as the model sees them, starts of units, document of each unit, hash of each unit)."""
        marked = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        if not n:
            return points, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        cut = np.ones(n, bool)
        k = self.classes[points]
        cut[1:] = ~self.together[k[:-1], k[1:]]
        cut[offsets[:-1][offsets[:-1] < n]] = True
        start = np.flatnonzero(cut)
        doc = np.searchsorted(offsets, start, "right") - 1
        return points, start, doc, hashes(points, start)


@lru_cache(2)
def load(path: str) -> PieceTable:
    """The table of a model file, read once in each process."""
    return PieceTable(path)


def hashes(points: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each unit that depends on its characters alone."""
    n = len(points)
    up, down = powers(_B, n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    return mixed((prefix[np.append(start[1:], n)] - prefix[start]) * down[start])


def strings(points: np.ndarray, start: np.ndarray, which: np.ndarray) -> list[str]:
    """The units `which`, as strings."""
    text = points.tobytes().decode("utf-32-le", "surrogatepass")
    end = np.append(start[1:], len(points))
    return [text[a:b] for a, b in zip(start[which].tolist(), end[which].tolist(), strict=True)]
