"""64-bit hashes of numbers and words, on whole arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd factors, each for a place or a use of its own.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
#: Bytes of words hashed at a time.
STRETCH = 1 << 20
_BASES = (0x100000001B3, 0x9E6C63D0876A9A47)
_powers = [np.ones(1, dtype=np.uint64) for _ in _BASES]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array, kind: int = 0) -> np.ndarray:
    """A 64-bit hash of each word (none empty); kinds 0 and 1 are independent."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    out = np.zeros(len(words), dtype=np.uint64)
    at = 0
    while at < len(words):  # a bounded stretch at a time
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STRETCH, side="right")) - 1)
        data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[at] : offsets[end]]
        starts, sizes = offsets[at:end] - offsets[at], np.diff(offsets[at : end + 1])
        longest = int(sizes.max())
        if len(_powers[kind]) < longest:
            _powers[kind] = np.cumprod(np.full(longest, _BASES[kind], dtype=np.uint64), dtype=np.uint64)
        place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, sizes)
        out[at:end] = mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _powers[kind][place], starts) + sizes.astype(np.uint64) * ODD[kind])
        at = end
    return out
