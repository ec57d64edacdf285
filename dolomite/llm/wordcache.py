"""Encoding by distinct words: texts are cut where no token can cross, and each distinct piece is encoded once a worker."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Flat ids, and each piece's start and size in them.
Coded = tuple[np.ndarray, np.ndarray, np.ndarray]


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start:start + size] of each piece, one after another, and where each ends."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - size), size) + np.arange(total)], ends


def flattened(lists: list[list[int]]) -> Coded:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum())), np.cumsum(size) - size, size


class WordCache:
    """Pieces and their ids. many: encodes a list of pieces.

    At `most` pieces, or `most_bytes` of theirs (long ones are whole texts where a script has no spaces), the cache starts anew.
    """

    def __init__(self, many: Callable[[list], Coded], most: int = 500_000, most_bytes: int = 16 << 20):
        self.many, self.most, self.most_bytes = many, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.known: pa.Array | None = None  # the pieces; an array of a few bytes each, where a dict of strings takes some 200
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def __len__(self) -> int:
        return 0 if self.known is None else len(self.known)

    def add(self, new: pa.Array) -> None:
        got, start, size = self.many(new.to_pylist())
        n = len(self)
        while self.used + len(got) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(new) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(got)] = got
        self.start[n : n + len(new)], self.size[n : n + len(new)] = self.used + start, size
        self.used += len(got)
        self.known = pa.concat_arrays([self.known, new]) if n else new

    def encode(self, pieces: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and their bounds. pieces: of all texts, none null; bounds: of each text's pieces in them."""
        coded = pieces.dictionary_encode()
        words = coded.dictionary
        if len(self) and (len(self) + len(words) > self.most or self.known.nbytes + words.nbytes > self.most_bytes):
            self.clear()
        at = np.full(len(words), -1) if self.known is None else pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new := np.flatnonzero(at < 0)):
            at[new] = len(self) + np.arange(len(new))
            self.add(words.take(pa.array(new)))
        each = at[np.asarray(coded.indices)]
        ids, ends = gathered(self.flat, self.start[each], self.size[each])
        return ids, np.concatenate([[0], ends])[bounds]

    def encode_lists(self, pieces: list[list], kind: pa.DataType) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.cumsum([0, *map(len, pieces)])
        return self.encode(pa.array(chain.from_iterable(pieces), kind, size=int(bounds[-1])), bounds)
