"""Words of whole texts as numpy arrays: bounds, 64-bit hashes and slices of bounded size.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D; these never occur inside a UTF-8 character.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
U64 = np.uint64
_BASE = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)  # odd, so each has an inverse modulo 2**64
_powers: dict[int, np.ndarray] = {}
#: Values that one prefix sum goes over; powers of more are not kept.
STRETCH = 1 << 17
#: Bytes of text that a task turns into Python objects, and hands back, at a time.
PART_BYTES = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; up to STRETCH + 1 of them are kept between calls, as long as the process lives."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, STRETCH + 1), base, dtype=U64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U64)
        if n <= STRETCH + 1:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64 (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, plus: int = 0) -> np.ndarray:
    """Rabin-Karp hash of values[start:end] + plus for every pair, from prefix sums modulo 2**64. Starts and ends ascend.

    A hash does not depend on where its values lie, so they are taken in stretches: a sum over a whole block, and the
    powers for it, would take many times the block's memory.
    """
    out, inverse, i = np.empty(len(starts), dtype=U64), pow(base, -1, 1 << 64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STRETCH, side="right")))
        begin, n = starts[i], int(ends[j - 1] - starts[i])
        prefix = np.zeros(n + 1, dtype=U64)
        np.cumsum((values[begin:begin + n].astype(U64) + U64(plus)) * powers(base, n), dtype=U64, out=prefix[1:])
        a, b = starts[i:j] - begin, ends[i:j] - begin
        out[i:j] = (prefix[b] - prefix[a]) * powers(inverse, n + 1)[a]
        i = j
    return out


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    edge = np.ones(len(data) + 2, dtype=np.int8)
    edge[1:-1] = SPACE[data]
    at = np.flatnonzero(np.diff(edge))
    return at[0::2], at[1::2]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word."""
    return mix(rolling(data, starts, ends, _BASE[0], 1))


def of_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, starts and ends of words, and the number of the first word of each text (and the end)."""
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    starts, ends = bounds(data)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    return data, starts, ends, np.searchsorted(starts, begins)


def windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, width: int):
    """First word of every window of so many words within one text, its hash, and a second, independent hash."""
    n = len(starts)
    if n < width:
        none = np.zeros(0, dtype=U64)
        return np.zeros(0, dtype=np.int64), none, none
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text_of[: n - width + 1] == text_of[width - 1:])
    h = hashes(data, starts, ends)
    return at, mix(rolling(h, at, at + width, _BASE[1])), mix(rolling(mix(h), at, at + width, _BASE[2]))


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about so many bytes each; a larger row is alone."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def parts(batches, at: int, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes in the column `at`, or one row: an Arrow batch has thousands of
    whole texts, and as Python objects, with what is made of them, they would lie in memory several times."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False)
        for begin, end in slices(sizes, most):
            yield b.slice(begin, end - begin)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
