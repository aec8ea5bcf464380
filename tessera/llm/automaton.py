"""Words of UTF-8 buffers, found and hashed over whole arrays of bytes.

A table turns each byte into its class: 0 where it parts words, or else the byte as the word
has it (A-Z in lower case). Words begin and end where the classes' difference from 0 changes.
A checksum is a table-driven automaton over bytes; it is run over all words side by side, one
byte of each in a step, the longer words first, so that those still running are a prefix.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes looked at together.
STRETCH = 1 << 20
#: Steps that words take side by side; what is left of longer ones runs by itself.
STEPS = 64


def byte_classes(ranges: list[tuple[int, int]]) -> np.ndarray:
    """The table of classes where bytes in ranges (ends included) are of words."""
    out = np.zeros(256, dtype=np.uint8)
    for lo, hi in ranges:
        out[lo : hi + 1] = np.arange(lo, hi + 1)
    out[65:91] = np.where(out[65:91] > 0, out[65:91] + 32, 0)
    return out


def crc_table(polynomial: int = 0xEDB88320) -> np.ndarray:
    """What eight steps of the shift register make of each byte (CRC-32, reflected)."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(polynomial), state >> 1).astype(np.uint32)
    return state


TABLE = crc_table()
START = np.uint32(0xFFFFFFFF)


class Words(NamedTuple):
    """Words of a stretch: its classes, the places of the words in them, and the row of each."""

    classes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray


def _whole_words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, at: int) -> int:
    """Where a stretch from at ends: about STRETCH bytes on, not inside a word."""
    stop = min(at + STRETCH, int(offsets[-1]))
    row = int(np.searchsorted(offsets, stop, side="right")) - 1
    if stop == offsets[-1] or offsets[row] == stop:
        return stop
    gaps = np.flatnonzero(classes[data[at : stop + 1]] == 0)
    back = max(int(offsets[row]), at + int(gaps[-1]) if len(gaps) else at)
    if back > at:
        return back
    while stop < offsets[row + 1]:  # one word fills the stretch and goes on
        more = np.flatnonzero(classes[data[stop : min(stop + STRETCH, int(offsets[row + 1]))]] == 0)
        if len(more):
            return stop + int(more[0])
        stop = min(stop + STRETCH, int(offsets[row + 1]))
    return stop


def words(texts: pa.Array, classes: np.ndarray) -> Iterator[Words]:
    """The words of texts (null: none), a stretch of whole words at a time; a text may take several stretches."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
    at = int(offsets[0])
    while at < offsets[-1]:
        stop = _whole_words(data, offsets, classes, at)
        own = classes[data[at:stop]]
        change = np.diff((own != 0).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        # texts that meet without a gap
        lo, hi = np.searchsorted(offsets, at, side="right"), np.searchsorted(offsets, stop)
        seams = np.unique(offsets[lo:hi]) - at
        seams = seams[(own[seams - 1] != 0) & (own[seams] != 0)]
        if len(seams):
            starts, ends = (np.insert(at_, np.searchsorted(at_, seams), seams) for at_ in (starts, ends))
        if len(starts):
            yield Words(own, starts, ends, np.searchsorted(offsets, starts + at, side="right") - 1)
        at = stop


def advance(states: np.ndarray, found: Words, which: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The register of each word (of those chosen), from states over the word's bytes."""
    starts, sizes = found.starts[which], (found.ends - found.starts)[which]
    steps = np.minimum(sizes, STEPS)
    order = np.argsort((STEPS - steps).astype(np.uint8), kind="stable")
    running = len(steps) - np.cumsum(np.bincount(steps, minlength=STEPS + 1))  # words with more bytes than the step's number
    at, state = starts[order], states[order]
    for k in range(STEPS):
        n = running[k]
        if not n:
            break
        now = state[:n]
        state[:n] = (now >> np.uint32(8)) ^ TABLE[(now ^ found.classes[at[:n] + k]) & np.uint32(255)]
    for i in np.flatnonzero(sizes[order] > STEPS):
        rest = found.classes[at[i] + STEPS : at[i] + sizes[order[i]]]
        state[i] = np.uint32(zlib.crc32(rest, int(state[i] ^ START))) ^ START
    out = np.empty_like(state)
    out[order] = state
    return out


def pushed(states: np.ndarray, byte: int) -> np.ndarray:
    """The registers after one more byte, the same for all."""
    return (states >> np.uint32(8)) ^ TABLE[(states ^ np.uint32(byte)) & np.uint32(255)]
