"""Vectorised byte kernels for use inside tasks.

They work on the buffers of an Arrow string column: `data` holds the UTF-8 bytes of
many texts, `offsets` where each begins.  Rolling hashes are pairs of polynomials over the
symbols modulo two primes below 2**31, so the hash of any substring comes from prefix sums.
(Modulo a power of two some pairs agree whatever the base, the Thue-Morse words for one.)
What must be equal is compared again by its users, on a digest or symbol by symbol.
"""
from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Prime and base of each polynomial.
MODULI = ((2147483647, 1779033703), (2147483629, 1013904242))
#: Texts are worked on together in chunks of so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def kept() -> types.ModuleType:
    """A place in this process for what later tasks can use again."""
    return sys.modules.setdefault("_lodestone_worker", types.ModuleType("_lodestone_worker"))


def powers(n: int, prime: int, base: int) -> np.ndarray:
    """base**0 .. base**(n - 1) by prime; a worker process keeps those for up to a few chunks."""
    known = kept().__dict__.setdefault("powers", {})
    out = known.get((prime, base), np.ones(1, U))
    while len(out) < n:
        out = np.concatenate([out, out * U(pow(base, len(out), prime)) % U(prime)])
    if len(out) <= 4 * CHUNK_BYTES:
        known[(prime, base)] = out
    return out[:n]


def release() -> None:
    """Gives freed memory of this worker process back to the system, so that a later stage finds it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def text_chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about CHUNK_BYTES; a null is an empty text.  One text is never split."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Rolling:
    """Substring hashes of one chunk of symbols below 2**32."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        symbols = data.astype(U) + U(1)
        small = int(symbols.max(initial=1)) * n < 1 << 33  # then no sum of products reaches 2**64
        self.sums = []
        for prime, base in MODULI:
            terms = symbols * powers(n, prime, base)
            sums = np.zeros(n + 1, U)
            np.cumsum(terms if small else terms % U(prime), out=sums[1:])
            self.sums.append(sums)

    def _raw(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Polynomial k of symbols start to end, as if they began the chunk."""
        prime, base = MODULI[k]
        back = powers(len(self.sums[k]), prime, pow(base, -1, prime))
        return (self.sums[k][end] - self.sums[k][start]) % U(prime) * back[start] % U(prime)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return finished(self._raw(0, start, end), self._raw(1, start, end), end - start)

    def joined(self, start: np.ndarray, cut: np.ndarray, go_on: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of symbols start to cut followed by go_on to end."""
        parts = []
        for k, (prime, base) in enumerate(MODULI):
            shift = powers(int((cut - start).max(initial=0)) + 1, prime, base)[cut - start]
            parts.append((self._raw(k, start, cut) + self._raw(k, go_on, end) * shift) % U(prime))
        return finished(*parts, cut - start + end - go_on)


def finished(one: np.ndarray, two: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of both polynomials and the length."""
    return mix((one << U(32) | two) + length.astype(U) * U(0xD1B54A32D192ED03))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that don't cross an offset."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def chunk_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row of a chunk the sorted distinct 64-bit hashes of its shingles of `width` words.

    A-Z lower-cased; words are split at ASCII white space; with fewer words the whole
    sequence is one shingle; without words the set is empty.
    """
    low = LOWER[data]
    start, end = runs(~SPACE[low], offsets)
    words = Rolling(low).hash(start, end)
    bounds = np.searchsorted(start, offsets)
    n = len(words)
    grams = np.zeros(max(0, n - width + 1), U)
    for k in range(width):
        grams = mix(grams + words[k : k + len(grams)] + U(k + 1))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            h = U(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = mix(np.array([h + w], U))[0]
            out.append(np.array([h], U))
        else:
            out.append(np.zeros(0, U))
    return out


def shingle_sets(column, width: int) -> Iterator[np.ndarray]:
    """chunk_shingles of each row of an Arrow column, in order."""
    for _, data, offsets in text_chunks(column):
        yield from chunk_shingles(data, offsets, width)
