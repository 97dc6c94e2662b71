"""Words of a batch of texts as numpy arrays: no Python object per word.

A batch is one byte buffer; words are (start, end) offsets into it. Hashes of words and of runs of
words come from prefix sums modulo 2^64 and cost a few array operations whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

#: Odd, so they have inverses modulo 2^64.
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_ALL = (1 << 64) - 1

#: Words of more bytes are hashed by XXH64: long ones could be made to agree in a sum of powers.
LONG_WORD = 32

#: UTF-8 bytes of texts handled at once; bounds the arrays of a task.
CHUNK_BYTES = 1 << 20


def translation(word_bytes: Iterable[int], lower: bool) -> bytes:
    """256-byte table: separators become a space, A-Z lower-case letters where ``lower``."""
    kept = set(word_bytes)
    return bytes((b + 32 if lower and 65 <= b <= 90 else b) if b in kept else 32
                 for b in range(256))


#: Everything but space and \\t \\n \\v \\f \\r.
SPACED = translation((b for b in range(256) if b not in (32, 9, 10, 11, 12, 13)), lower=False)
SPACED_LOWER = translation((b for b in range(256) if b not in (32, 9, 10, 11, 12, 13)), lower=True)
#: ASCII letters (lower-cased), digits and every byte of a character beyond ASCII.
ALNUM_LOWER = translation([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)],
                          lower=True)


def chunks(values: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of at most ``limit`` bytes (a longer text stands alone)."""
    start = size = 0
    for i, value in enumerate(values):
        n = len(value or b"")
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(values):
        yield start, len(values)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n; kept up to a few chunks in length."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 17))
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        have = (tables[0], tables[1])
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[0][:n], have[1][:n]


@dataclass
class Words:
    buffer: bytes
    start: np.ndarray
    end: np.ndarray
    #: Words of text i are first[i] .. first[i + 1].
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def left_in_text(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))

    def word(self, i: int) -> bytes:
        return self.buffer[self.start[i]:self.end[i]]

    def words(self, i: int, j: int) -> list[bytes]:
        return [self.buffer[s:e] for s, e in zip(self.start[i:j].tolist(), self.end[i:j].tolist(),
                                                 strict=True)]

    def hashes(self) -> np.ndarray:
        data = np.frombuffer(self.buffer, dtype=np.uint8)
        up, down = _power_tables(_BYTE_BASE, len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
        out = mix((sums[self.end] - sums[self.start]) * down[self.start])
        for i in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            out[i] = xxhash.xxh64_intdigest(self.buffer[self.start[i]:self.end[i]], LONG_WORD)
        return out


def split_words(values: list[bytes | None], table: bytes) -> Words:
    sizes = np.fromiter((len(v or b"") + 1 for v in values), dtype=np.int64, count=len(values))
    buffer = b" " + b"".join((v or b"") + b" " for v in values).translate(table)
    inside = np.frombuffer(buffer, dtype=np.uint8) != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return Words(buffer, start, end, np.searchsorted(start, bounds + 1))


def run_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words; entry i starts at word i."""
    n = len(word_hashes)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    up, down = _power_tables(_WORD_BASE, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(word_hashes * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:n - k + 1]) * down[:n - k + 1] + np.uint64(k))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    span, low = 1, values
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low
