"""Streams of frames sorted by a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def whole_groups(frames: Iterator[pd.DataFrame], *keys: str, most: int = 1 << 62) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted frames -> frames that end where a group ends, with the starts of their groups and their length.

    A group of more than most rows is cut into groups of so many, so that what is held is bounded.
    """
    rest = None
    for f in frames:
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        if not len(f):
            continue
        values = f[list(keys)].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]).any(axis=1)]))
        if len(f) > most:
            starts = np.concatenate([np.arange(a, b, most) for a, b in zip(starts, np.append(starts[1:], len(f)))])
        if starts[-1]:
            yield f.iloc[: starts[-1]], starts
        rest = f.iloc[starts[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])
