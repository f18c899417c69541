"""Vectorised words and shingles of Arrow string columns, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once: bounds the memory of a worker whatever the batch holds.
CHUNK = 1 << 20
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(int(_rng.integers(1, 1 << 62)) * 8 + 5)
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    size = max(CHUNK, 1 << (n - 1).bit_length()) if n else CHUNK
    if size not in _powers:
        inverse = pow(int(_BASE), -1, 2**64)
        up, down = (np.full(size, b, dtype=np.uint64) for b in (_BASE, np.uint64(inverse)))
        up[0] = down[0] = 1
        if size > CHUNK:
            return np.cumprod(up), np.cumprod(down)
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets; a null row has no bytes."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and for each row where its words begin (one more at the end)."""
    data, offsets = _buffers(column)
    total, at = len(data), 0
    hashes, starts = [], []
    cut = np.zeros(total + 1, dtype=bool)
    cut[offsets[:-1]] = True
    while at < total:
        end = min(total, at + CHUNK)
        while end < total and not _GAP[data[end]] and not cut[end]:
            end += 1
        part = data[at:end]
        inside = ~_GAP[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | cut[at + 1 : end]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | cut[at + 1 : end]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        up, down = _power(len(part))
        sums = np.cumsum(_BYTE[_LOWER[part]] * up[: len(part)])
        before = np.where(s > 0, sums[s - 1], np.uint64(0))
        hashes.append(mix((sums[e] - before) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles of ``width`` words; of fewer words, of the whole sequence."""
    words, bounds = word_hashes(column)
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        rolled = mix(rolled + words[k : k + n], k + 1)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            short = np.zeros(1, dtype=np.uint64)
            for k, w in enumerate(words[a:b]):
                short = mix(short + w, 100 + k)
            yield mix(short, 200 + int(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 * CHUNK) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about ``limit`` bytes together."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end
