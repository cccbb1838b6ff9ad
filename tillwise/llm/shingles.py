"""Sets of hashed word shingles, for many texts at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Odd multipliers of a multiply-and-fold hash.
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_C = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)

#: ASCII capitals become small, the six white-space characters become spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> _HALF)


def word_hashes(texts: Sequence[str | None], fold: bytes = FOLD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words and, per text, where its words end among them."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buffer = b" ".join([*raw, b""]).translate(fold) + b" "
    codes = np.frombuffer(buffer, np.uint8)
    inside = np.concatenate([[False], codes != 32, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    blocks = np.ndarray((len(buffer),), "<u8", buffer + bytes(8), 0, (1,))
    left = ends - starts
    hashes = _mix(blocks[starts] & _KEEP[np.minimum(left, 8)]) + left.astype(np.uint64) * _A
    at, rest = 8, np.flatnonzero(left > 8)
    while len(rest):
        more = blocks[starts[rest] + at] & _KEEP[np.minimum(left[rest] - at, 8)]
        hashes[rest] = _mix(hashes[rest] * _A + more)
        at += 8
        rest = rest[left[rest] > at]
    limits = np.cumsum([len(r) + 1 for r in raw])
    return _mix(hashes), np.searchsorted(starts, limits, "left")


def shingle_sets(texts: Sequence[str | None], size: int = 3) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``size``-word shingles.

    A text with fewer words, but not none, has its whole sequence of words as one shingle.
    """
    hashes, ends = word_hashes(texts)
    whole = hashes.copy()
    for k in range(1, size):
        whole[: len(whole) - k] = _mix(whole[: len(whole) - k] * _A + hashes[k:]) if len(whole) > k else whole[:0]
    out, begin = [], 0
    for end in ends.tolist():
        n = end - begin
        if n >= size:
            found = np.sort(whole[begin : end - size + 1])
            found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif n:
            found = hashes[begin : begin + 1]
            for k in range(1, n):
                found = _mix(found * _A + hashes[begin + k : begin + k + 1])
            found = found ^ np.uint64(n)
        else:
            found = np.zeros(0, np.uint64)
        out.append(found)
        begin = end
    return out
