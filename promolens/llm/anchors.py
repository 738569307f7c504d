"""Content-defined anchors of long repeats.

A window of ``LENGTH`` bytes is judged at its anchor, the leftmost of its k-grams with
the smallest hash.  Equal windows have their anchors at the same offset, so a repeat can
be found by comparing texts around equal anchors only; there is about one anchor in 70
bytes.  Consecutive windows with one anchor form a run, and the bytes that the run's
windows cover are its extent.
"""

from __future__ import annotations

import numpy as np

from .common import _VALUE, mix64, powers, prefix_hash

#: Bytes of an anchor's k-gram; bytes that are handled at a time; bits of a position in them.
GRAM, PIECE, BITS = 32, 1 << 19, 20


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost of the smallest (by their upper 44 bits) of every w consecutive values."""
    n = len(x) - w + 1
    key = (x >> np.uint64(BITS) << np.uint64(BITS)) | np.arange(len(x), dtype=np.uint64)
    full = np.concatenate((key, np.full(-len(key) % w, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    forward = np.minimum.accumulate(full, axis=1).reshape(-1)[w - 1 : w - 1 + n]
    backward = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:n]
    return (np.minimum(backward, forward) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def runs(raw: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(hash of the anchor's k-gram, hash of the extent and its place, first window, last window, anchor) of each run."""
    out = []
    for at in range(0, max(0, len(raw) - length + 1), PIECE):
        part = raw[at : at + PIECE + length - 1]
        if len(part) < length:
            break
        n = len(part)
        h, (_, inverse) = prefix_hash(part, _VALUE), powers(len(part) + 1)
        gram = mix64((h[GRAM:] - h[:-GRAM]) * inverse[: n - GRAM + 1])
        anchor = window_minima(gram, length - GRAM + 1)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.append(first[1:], len(anchor)) - 1
        anchor = anchor[first]
        extent = mix64((h[last + length] - h[first]) * inverse[first])
        extent = mix64(extent ^ ((anchor - first).astype(np.uint64) << np.uint64(10) | (last - first).astype(np.uint64)))
        out.append((gram[anchor], extent, first + at, last + at, anchor + at))
    if not out:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out))
