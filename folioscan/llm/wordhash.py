"""Hashes of words and of runs of words, for whole Arrow batches at a time.

Numbers of 64 bits are mixed one into another, and never summed as powers of a base, which would give whoever knows the base
texts that differ and hash alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text, documents and words that are hashed at a time; bytes of the longest word that is hashed as two numbers.
SEGMENT, DOCUMENTS, BLOCK, PACKED = 1 << 20, 2048, 1 << 17, 16

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each document and in all) of the words of documents that lie one after another."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * np.uint64(0x9E3779B97F4A7C15) + y)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each word, as two numbers: the bytes of short words mixed twice, and XXH3 of longer ones."""
    import xxhash

    padded = np.zeros(len(data) + PACKED, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + PACKED - 7,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each byte
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
    one, two = np.empty(len(starts), dtype=np.uint64), np.empty(len(starts), dtype=np.uint64)
    for at in range(0, len(starts), BLOCK):
        some = slice(at, at + BLOCK)
        s, size = starts[some], ends[some] - starts[some]
        n = size.astype(np.uint64)
        low, high = eight[s] & masks[np.minimum(size, 8)], eight[s + 8] & masks[np.clip(size - 8, 0, 8)]
        one[some] = _join(mix(low + n * np.uint64(0xC2B2AE3D27D4EB4F)), high)
        two[some] = _join(mix(high ^ np.uint64(0x165667B19E3779F9)) + n, low)
    raw = memoryview(padded)
    for i in np.flatnonzero(ends - starts > PACKED):
        h = xxhash.xxh3_128_intdigest(raw[starts[i] : ends[i]])
        one[i], two[i] = h >> 64, h & (1 << 64) - 1
    return one, two


def _runs(lanes: list[np.ndarray], width: int) -> list[np.ndarray]:
    n, out, done, power = len(lanes[0]) - width + 1, None, 0, 1
    while True:
        if width & power:
            here = [x[done : done + n] for x in lanes]
            out, done = here if out is None else [_join(o, x) for o, x in zip(out, here, strict=True)], done + power
        if done == width:
            return [mix(x + np.uint64(width)) for x in out]
        m = len(lanes[0]) - power
        first, second = [x[:m] for x in lanes], [x[power:] for x in lanes]
        # with two lanes, each takes the other's second half
        lanes = [_join(x + np.uint64(k * 0x27D4EB2F165667C5 & (1 << 64) - 1), y) for k, (x, y) in enumerate(zip(first, reversed(second), strict=True))]
        power *= 2


def run_hashes(width: int, *lanes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the runs of width words from each word, in as many lanes; the last width - 1 words have none. Runs may cross documents.

    Runs of 1, 2, 4, ... words are mixed from two of half the length, and those that make up width from left to right.
    """
    n = max(0, len(lanes[0]) - width + 1)
    out = [np.empty(n, dtype=np.uint64) for _ in lanes]
    for at in range(0, n, BLOCK):
        for whole, some in zip(out, _runs([x[at : at + BLOCK + width - 1] for x in lanes], width), strict=True):
            whole[at : at + BLOCK] = some
    return out


def hashed_batches(batch: pa.RecordBatch, column: int, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batch of some SEGMENT bytes of text and DOCUMENTS rows at most, with the words' two hashes and the words before each document."""
    for part, data, starts, ends, before in spans_of(batch, column, lower):
        yield part, *word_hashes(data, starts, ends), before


def spans_of(batch: pa.RecordBatch, column: int, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    texts = batch.column(column)
    wide = texts.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    if not len(wide):
        return
    whole = np.frombuffer(wide.buffers()[2], dtype=np.uint8) if wide.buffers()[2] is not None and offsets[-1] else np.empty(0, dtype=np.uint8)
    at = 0
    while at < len(wide):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SEGMENT, side="right")) - 1)
        to = min(to, at + DOCUMENTS, len(wide))
        data = whole[offsets[at] : offsets[to]]
        starts, ends, before = word_spans(data, offsets[at : to + 1] - offsets[at])
        yield batch.slice(at, to - at), _LOWER[data] if lower else data, starts, ends, before
        at = to
