"""Vectorised text kernels that run inside Spark tasks.

Everything works on Arrow string columns as flat UTF-8 byte buffers, one chunk
of a few megabytes at a time, so memory in a Python worker is bounded by the
chunk size (or by one document, if a single document is longer than that).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once by a task; numpy temporaries take about 20 times as much.
CHUNK_BYTES = 2 << 20

U64 = np.uint64
#: Odd multipliers of the 64-bit finaliser (the public splitmix64 constants).
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
GOLDEN = U64(0x9E3779B97F4A7C15)

#: Byte classes, indexed by byte value.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: a bijection on 64-bit words."""
    x = x ^ (x >> U64(30))
    x *= MIX_A
    x ^= x >> U64(27)
    x *= MIX_B
    x ^= x >> U64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * GOLDEN + (b ^ (b >> U64(29))) * MIX_B + U64(0x2545F4914F6CDD1D))


def text_chunks(
    batches: Iterable[pa.RecordBatch], column: str = "text", budget: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most ``budget`` bytes of ``column`` (one row at least).

    At the end freed memory goes back to the system: workers wait for other tasks.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = flat(batch.column(column))[0][1:]
        lo = 0
        while lo < n:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + budget, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    pa.default_memory_pool().release_unused()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_binary(column.type) or pa.types.is_string(column.type)):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offs is None or offs.size == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    o = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o - o[0], raw[o[0] : o[-1]]


def padded(data: np.ndarray, extra: int = 64) -> np.ndarray:
    out = np.zeros(len(data) + extra, np.uint8)
    out[: len(data)] = data
    return out


def words64(buf: np.ndarray) -> np.ndarray:
    """View of the little-endian 8-byte word at every byte position (needs 8 bytes of padding)."""
    return np.ndarray((len(buf) - 7,), np.dtype("<u8"), buf, 0, (1,))


_KEEP = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; ``buf`` must be padded by 8 bytes."""
    at = words64(buf)
    out = np.zeros(len(starts), np.uint64)
    live, s, left = np.arange(len(starts)), starts, lengths
    first = True
    while len(live):
        part = at[s] & _KEEP[np.minimum(left, 8)]
        new = mix(out[live] + part * GOLDEN + (left.astype(np.uint64) << U64(56)) + U64(1))
        if first:
            out = new
        else:
            out[live] = new
        more = left > 8
        live, s, left, first = live[more], s[more] + 8, left[more] - 8, False
    return out


def word_spans(offsets: np.ndarray, data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets per document) of maximal runs of non-separator bytes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    before = np.ones(n, bool)
    before[1:] = ~inside[:-1]
    cut = offsets[offsets < n]
    before[cut] = True
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:]
    cut = offsets[offsets > 0] - 1
    after[cut] = True
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive items (len(h) - k + 1 of them), by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, out, done = h, 1, None, 0
    while True:
        if k & size:
            out = power[:n] if out is None else combine(out[:n], power[done : done + n])
            done += size
        if size * 2 > k:
            return mix(out + U64(k))
        power = combine(power[: len(power) - size], power[size:])
        size *= 2


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost smallest of every w consecutive hashes (compared by their top 40 bits)."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, block = U64((1 << 24) - 1), 1 << 23
    if n > block:  # one very long document: piece by piece
        return np.concatenate([window_argmin(h[a : a + block + w - 1], w) + a for a in range(0, n, block)])
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    if size < w:
        key = np.minimum(key[:n], key[w - size : w - size + n])
    return (key[:n] & low).astype(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + l)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - base, lengths)


def removal_mask(size: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Boolean mask of the positions covered by the intervals."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0
