"""Content-defined anchors of fixed-length windows.

Every window of a sequence is charged to one anchor: the leftmost smallest hash among the first ``span`` positions
of the window. Equal windows choose equal anchors at the same offset, wherever they stand, because the choice looks
at nothing outside the window. Consecutive windows share an anchor, so a sequence of n windows has about
2 * n / (span + 1) anchors, and never a stretch without one.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def runs(hashes: np.ndarray, span: int, windows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor) of each run of windows 0..windows-1 with one anchor; ``hashes`` holds at least
    windows + span - 1 positions."""
    found = []
    for at in range(0, windows, BLOCK // 2):
        n = min(BLOCK // 2, windows - at)
        own = hashes[at : at + n + span - 1]
        low = np.uint64(BLOCK - 1)
        keys = (own & ~low) | np.arange(len(own), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            keys = np.minimum(keys[:-width], keys[width:])
            width *= 2
        keys = np.minimum(keys[:n], keys[span - width : span - width + n])
        anchor = (keys & low).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
        last = np.concatenate((first[1:] - 1, [n - 1]))
        found.append((first + at, last + at, anchor[first] + at))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def covered(first: np.ndarray, last: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of ``length`` that starts in one of the ranges first..last."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(last + length, n), -1)
    return np.cumsum(edge[:-1]) > 0
