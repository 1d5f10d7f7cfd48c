"""Array view of a batch of texts: word spans, hashes and per-document sums, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text looked at together; one document longer than this is a batch of its own.
BATCH_BYTES = 500_000

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


VALUE = scrambled(np.arange(1, 257, dtype=np.uint64))


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done = 1, 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


#: Entries of a table that a worker keeps for its life; longer ones are made for each batch.
KEPT_POWERS = 1 << 16
_POWERS: dict[int, np.ndarray] = {}


def power_table(base: int, n: int) -> np.ndarray:
    if n > KEPT_POWERS:
        return powers(base, n)
    if base not in _POWERS:
        _POWERS[base] = powers(base, KEPT_POWERS)
    return _POWERS[base][:n]


class Texts:
    """Texts joined with newlines between them.

    data: bytes; bounds: where each text begins (and one past the last separator); starts, ends: word
    spans; doc: the text of each word.
    """

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.n = len(raw)
        self.data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
        self.space = SPACE[self.data]
        edge = np.diff(np.concatenate([[True], self.space]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.doc = np.searchsorted(self.bounds, self.starts, side="right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.n)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = FOLD) -> np.ndarray:
        """64-bit hashes of byte spans, after mapping bytes through table."""
        size = len(self.data) + 1
        sums = np.zeros(size, np.uint64)
        sums[1:] = VALUE[table][self.data]
        sums[1:] *= power_table(BASE, size - 1)
        np.cumsum(sums, out=sums)
        out = (sums[ends] - sums[starts]) * power_table(INVERSE, size)[starts]
        return scrambled(out + (ends - starts).astype(np.uint64))

    def total(self, per_byte: np.ndarray) -> np.ndarray:
        """Sums per text of a number per byte."""
        sums = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of width words inside one text, and the index of each run's first word."""
        if len(hashes) < width:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[: len(hashes) - width + 1] == self.doc[width - 1 :])
        out = np.zeros(len(at), np.uint64)
        for k in range(width):
            out = out * np.uint64(BASE) + hashes[at + k]
        return scrambled(out), at


def keyed(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return hashes ^ scrambled(doc.astype(np.uint64) + np.uint64(1))


def batches(frames: Iterator[pd.DataFrame], text: str = "text", rows: int = 1 << 20) -> Iterator[tuple[pd.DataFrame, Texts]]:
    """Frames cut so that each has about BATCH_BYTES characters and at most so many rows, with their texts."""
    for frame in frames:
        sizes = frame[text].str.len().fillna(0).to_numpy(np.int64)
        part = np.stack([np.cumsum(sizes) // BATCH_BYTES, np.arange(len(frame)) // rows])
        cuts = [0, *(np.flatnonzero((part[:, 1:] != part[:, :-1]).any(axis=0)) + 1), len(frame)] if len(frame) else []
        for a, b in zip(cuts, cuts[1:]):
            own = frame.iloc[a:b].reset_index(drop=True)
            yield own, Texts([t if isinstance(t, str) else None for t in own[text]])
