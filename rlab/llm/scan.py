"""Vectorised scanning of Arrow text batches inside Spark tasks: flat bytes, words and their hashes.

Every helper works on whole texts. A null text counts as empty. Batches are cut into pieces of about ``max_bytes``,
so that the memory of a task does not grow with the batch; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PIECE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of `[^\x20\x09-\x0D]+`: anything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, lower-case ASCII letters and everything above ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C55
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of a hash base and of its inverse modulo 2**64, grown on demand and kept per process. Hashes modulo 2**64
    only deal work out: long strings that collide for every base are known, so they never decide equality."""

    up = np.ones(1, dtype=U64)
    down = np.ones(1, dtype=U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, PIECE_BYTES + (PIECE_BYTES >> 2))
            steps = np.full(n, _BASE, dtype=U64)
            steps[0] = 1
            cls.up = np.multiply.accumulate(steps)
            steps[1:] = pow(_BASE, -1, 1 << 64)
            cls.down = np.multiply.accumulate(steps)
        return cls.up, cls.down


#: The prime 2**61 - 1 and a base drawn once at random: two strings of n bytes collide with a chance of n / 2**61.
PRIME = (1 << 61) - 1
_PRIME_BASE = 0x0B7C4E1D93A85F27
_M61, _M31, _M30 = U64(PRIME), U64((1 << 31) - 1), U64((1 << 30) - 1)
_S61, _S31, _S30, _ONE = U64(61), U64(31), U64(30), U64(1)
#: Bytes summed at once: few enough to stay in the cache, and that products of halves sum up without overflow.
_SUM_BYTES = 1 << 14


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & _M61) + (x >> _S61)
    return np.where(x >= _M61, x - _M61, x)


def _times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, by halves of 31 bits: 2**61 is 1 and 2**62 is 2 there."""
    high, low, y_high, y_low = x >> _S31, x & _M31, y >> _S31, y & _M31
    mid = high * y_low + low * y_high
    return _reduced(((high * y_high) << _ONE) + (mid >> _S30) + ((mid & _M30) << _S31) + low * y_low)


class _PrimePowers:
    """Powers of the base, in halves of 31 bits, and of its inverse modulo the prime; grown on demand."""

    low = high = np.zeros(0, dtype=U64)
    down = np.zeros(0, dtype=U64)

    @staticmethod
    def _row(base: int, n: int) -> np.ndarray:
        out = np.ones(n, dtype=U64)
        size = 1
        while size < n:
            more = min(size, n - size)
            out[size : size + more] = _times(out[:more], np.full(1, pow(base, size, PRIME), dtype=U64))
            size += more
        return out

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(cls.down) < n:
            n = max(n, PIECE_BYTES + (PIECE_BYTES >> 2))
            up = cls._row(_PRIME_BASE, n)
            cls.low, cls.high, cls.down = up & _M31, up >> _S31, cls._row(pow(_PRIME_BASE, -1, PRIME), n)
        return cls.low, cls.high, cls.down


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of the batch whose texts hold about ``max_bytes``; a longer text is a piece of its own."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        low = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, low + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def flat(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, a line feed after each, and the start of each (with the total at the end)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    _, offsets, data = joined.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]] if len(joined) else np.zeros(0, np.uint8)
    return (_LOWER[raw] if lower else raw), starts - starts[0]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Sums such that ``span_hash`` gives the hash of any span in constant time: a polynomial modulo 2**61 - 1. The sums
    are below 2**61 + 8, not fully reduced."""
    low, high, _ = _PrimePowers.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=U64)
    for at in range(0, len(raw), _SUM_BYTES):
        to = min(at + _SUM_BYTES, len(raw))
        digit = raw[at:to].astype(U64)
        digit += _ONE
        upper = np.cumsum(digit * high[at:to])
        digit *= low[at:to]
        total = np.cumsum(digit, out=digit)
        total += sums[at]
        total += (upper & _M30) << _S31  # upper is below 2**61
        total += upper >> _S30
        np.bitwise_and(total, _M61, out=sums[at + 1 : to + 1])
        sums[at + 1 : to + 1] += total >> _S61
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; equal spans have equal hashes wherever they stand."""
    down = _PrimePowers.upto(len(sums))[2]
    return mix(_times(_reduced(sums[ends] + U64(2 * PRIME) - sums[starts]), down[starts]) + _ONE)


def rolling_hash(raw: np.ndarray, size: int) -> np.ndarray:
    """Cheap hash of every span of ``size`` bytes, modulo 2**64: to deal spans out, not to compare them."""
    up, down = _Powers.upto(len(raw) + 1)
    sums = np.empty(len(raw) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: len(raw) - size + 1] + U64(size))


def words(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words and the number of words before each text (with the total at the end)."""
    starts, ends = runs(is_word[raw])
    return starts, ends, np.searchsorted(starts, offsets)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbours; the result has n - 1 entries less."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out *= U64(0xD6E8FEB86659FD93)
        out += hashes[k : k + m]
    return mix(out + U64(n))


def owners(counts: np.ndarray) -> np.ndarray:
    """0 repeated counts[0] times, 1 repeated counts[1] times, and so on."""
    return np.repeat(np.arange(len(counts), dtype=np.int64), counts)
