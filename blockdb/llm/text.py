"""Words and their hashes by array arithmetic over the UTF-8 bytes of many texts at once.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit polynomials of the bytes,
finished by an avalanche step, so equal words have equal hashes in every process. Polynomials modulo 2**64 are weak on long spans (Thue-Morse words of two
letters collide), so spans of more than LONG bytes are hashed by BLAKE2b instead.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once; a longer text is handled alone.
BLOCK_BYTES = 400_000
#: Spans of more bytes are hashed by BLAKE2b.
LONG = 32

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


VALUE = mix(np.arange(1, 257, dtype=U) * U(BASE))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, BLOCK_BYTES + 65536), U)
        have[0] = 1
        done = 1
        while done < len(have):
            step = min(done, len(have) - done)
            have[done : done + step] = have[:step] * U(pow(base, done, 1 << 64))
            done += step
        if len(have) <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


@dataclass
class Words:
    """Words of several texts: byte range, text number and hash of each word; `first` has each text's first word."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    prefix: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inv = powers(INVERSE, len(self.data) + 1)
        out = mix((self.prefix[end] - self.prefix[start]) * inv[start] + (end - start).astype(U) * U(BASE))
        long = np.flatnonzero(end - start > LONG)
        if len(long):
            raw, digest = memoryview(np.ascontiguousarray(self.data)), hashlib.blake2b
            out[long] = np.frombuffer(b"".join([digest(raw[a:b], digest_size=8).digest() for a, b in zip(start[long].tolist(), end[long].tolist())]), U)
        return out


def scan(texts: list[str | None], lower: bool = False) -> Words:
    """`bounds[i]:bounds[i+1]-1` are the bytes of text i; texts are parted by one space."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if lower:
        data = LOWER[data]
    bounds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=bounds[1:])
    word = ~SEPARATOR[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    prefix = np.zeros(len(data) + 1, U)
    np.cumsum(VALUE[data] * powers(BASE, len(data)), out=prefix[1:])
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(raw)), np.diff(first))
    out = Words(data, bounds, start, end, doc, start, first, prefix)
    out.hash = out.span_hash(start, end)
    return out


def blocks(texts: list[str | None], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` characters, at least one text each."""
    at = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(texts):
        yield at, len(texts)
    release()


def release() -> None:
    """Give freed memory back to the system: workers live on between steps and should hold no more than they use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def windows(words: Words, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each window of k consecutive words of one text."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, U)
    forward, inv = powers(BASE, n + 1), powers(INVERSE, n + 1)
    prefix = np.zeros(n + 1, U)
    np.cumsum(words.hash * forward[:n], out=prefix[1:])
    at = np.flatnonzero(words.doc[: n - k + 1] == words.doc[k - 1 :])
    return at, mix((prefix[at + k] - prefix[at]) * inv[at] + U((k * BASE + seed * 0xD1342543DE82EF95) & (2**64 - 1)))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(keys)
    s = keys[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.empty(len(s), bool)
    out[order] = same
    return out


def covered(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Which of n places lie in a window of k places that starts at one of `at` (sorted, distinct)."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, at, 1)
    np.subtract.at(mark, np.minimum(at + k, n), 1)
    return np.cumsum(mark[:n]) > 0
