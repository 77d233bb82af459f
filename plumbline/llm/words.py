"""Words of a column of texts as 64-bit hashes, worked out on the raw bytes of a batch.

A word is a run of bytes that the alphabet keeps. A byte stands for a random odd number and
a word for the polynomial of its bytes, so a whole batch needs a few passes and no dictionary.
Two given words share a hash with a probability of about 2**-58.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

WINDOW = 1 << 16
MULTIPLIER = 0x9E3779B97F4A7C15


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()


def _kept(drop) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(drop)] = False
    return table


#: Runs without ASCII white space; runs of ASCII letters, digits and anything beyond ASCII.
SPACED = _kept([0x20, *range(0x09, 0x0E)])
ALPHANUMERIC = _kept([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
RANDOM = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * 2 + 1
RANDOM_LOWERED = RANDOM[LOWER]


class Powers:
    """Powers of the multiplier and of its inverse, grown as far as a word or window needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                inverse = pow(MULTIPLIER, -1, 1 << 64)
                steps = np.ones(max(n, WINDOW + 1), dtype=np.uint64)
                steps[1:] = MULTIPLIER
                self.up = np.cumprod(steps, dtype=np.uint64)
                steps[1:] = inverse
                self.down = np.cumprod(steps, dtype=np.uint64)
        return self.up, self.down


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of a 64-bit number over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """hashes of all words of a batch; start and end in data; first[i]:first[i+1] are row i's."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    shapes: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> bytes:
        return LOWER[self.data[self.start[i] : self.end[i]]].tobytes()


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 places where its rows begin; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str = "text", most: int = 4 << 20):
    """The same rows in batches of at most about ``most`` bytes of text, or one row where it is longer."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        low, total = 0, 0
        for high, size in enumerate(lengths.tolist()):
            if total and total + size > most:
                yield batch.slice(low, high - low)
                low, total = high, 0
            total += size
        if low < batch.num_rows:
            yield batch.slice(low)


def shape_classes() -> np.ndarray:
    """Lower-case letters, capitals and digits each count as one sign; other signs as themselves."""
    table = np.arange(256, dtype=np.uint8)
    table[97:123] = table[128:] = 97
    table[65:91] = 65
    table[48:58] = 48
    return table


SHAPES = shape_classes()


def words_of(texts, keep: np.ndarray, shapes: bool = False, powers: Powers | None = None) -> Words:
    """Words of every row, ASCII capitals lowered. ``shapes`` adds a hash of each word's pattern
    of letters, digits and signs, in which a run of one kind counts once."""
    data, offsets = text_bytes(texts)
    powers = powers or Powers()
    ends_of_rows = offsets[1:]
    out: list[tuple] = []
    at = 0
    while at < len(data):
        to = min(len(data), at + WINDOW)
        while to < len(data):
            # Cut after the last byte of no word, or at a row's end; a longer word widens the window.
            row = ends_of_rows[np.searchsorted(ends_of_rows, to, side="right") - 1] if ends_of_rows[0] <= to else 0
            gaps = np.flatnonzero(~keep[LOWER[data[at:to]]])
            cut = max(int(row), at + int(gaps[-1]) + 1 if len(gaps) else 0)
            if cut > at:
                to = cut
                break
            to = min(len(data), to + WINDOW)
        out.append(_window(data[at:to], at, offsets, keep, shapes, powers))
        at = to
    if not out:
        empty = np.zeros(0, np.int64)
        return Words(empty.astype(np.uint64), empty, empty, np.zeros(len(offsets), np.int64), data, empty.astype(np.uint64) if shapes else None)
    hashes, start, end, shaped = (np.concatenate([o[i] for o in out]) if out[0][i] is not None else None for i in range(4))
    return Words(hashes, start, end, np.searchsorted(start, offsets, side="left"), data, shaped)


def _window(raw: np.ndarray, at: int, offsets: np.ndarray, keep: np.ndarray, shapes: bool, powers: Powers):
    up, down = powers.reach(len(raw) + 1)
    inside = np.take(keep[LOWER], raw)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    # A row's first byte begins a word even when the row before ended in one.
    rows = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, at + len(raw))] - at
    begins[rows] = inside[rows]
    start = np.flatnonzero(begins)
    stops = np.zeros(len(raw) + 1, dtype=bool)
    stops[1:] = inside
    stops[1:-1] &= ~inside[1:] | begins[1:]
    end = np.flatnonzero(stops)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(np.take(RANDOM_LOWERED, raw) * up[: len(raw)], out=total[1:])
        hashes = mix((total[end] - total[start]) * down[start] + np.uint64(1))
        shaped = None
        if shapes:
            kind = np.take(SHAPES, raw)
            fresh = begins.copy()
            fresh[1:] |= kind[1:] != kind[:-1]
            fresh &= inside
            rank = np.cumsum(fresh) - fresh
            np.cumsum(np.where(fresh, np.take(RANDOM, kind) * np.take(up, rank), np.uint64(0)), out=total[1:])
            shaped = mix((total[end] - total[start]) * down[rank[start]] + np.uint64(2))
    return hashes, start + at, end + at, shaped


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position of the last axis on; the last n - 1 have none."""
    m = max(0, hashes.shape[-1] - n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros((*hashes.shape[:-1], m), dtype=np.uint64)
        for i in range(n):
            total += hashes[..., i : i + m] * np.uint64(pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64))
        return mix(total + np.uint64(n))
