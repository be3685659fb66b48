"""Words and hashes of whole Arrow batches of text, in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: The odd multiplier of the hashes, and a random value for each byte.
_R = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240101))
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_KEPT: dict[tuple[str, object], object] = {}


def keep_in_worker(kind: str, key: object, make: Callable[[], object]) -> object:
    """What make() gives for this key, kept in the worker for its next tasks until anything else is kept.

    Workers outlive stages, so the caches of one operator must not lie beside those of the next.
    """
    if (kind, key) not in _KEPT:
        _KEPT.clear()
        _KEPT[kind, key] = make()
    return _KEPT[kind, key]


def keep_nothing() -> None:
    """Give up what this worker keeps, before work that needs its memory."""
    _KEPT.clear()


def small(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`: what is made of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about `most` bytes, one row at least. Nulls have no bytes."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
        kind = np.int64
    else:
        column = column.cast(pa.string())
        kind = np.int32
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


def powers(n: int, r: int = _R) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i up to n."""
    if r not in _powers or len(_powers[r][0]) <= n:
        size = max(n + 1, 1 << 20)
        both = []
        for x in (r, pow(r, -1, 1 << 64)):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        _powers[r] = (both[0], both[1])
    return _powers[r]


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, r: int = _R, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each span of the bytes, the same for equal spans wherever they stand.

    Spans come in order of their starts. They are taken in groups that start within `block` bytes, so a text of any
    length needs no more room than a block and the longest span.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        end = int(np.searchsorted(starts, low + block))
        own, high = slice(at, end), int(stops[at:end].max())
        part = data[low:high]
        up, down = powers(len(part), r)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[part] * up[: len(part)], out=sums[1:])
        a, b = starts[own] - low, stops[own] - low
        out[own] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = end
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, rows) of maximal runs of bytes that are no separators, never over a row's end."""
    inside = ~separator[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[: len(data)]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    stops = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1
