"""Vectorised words, rolling hashes and content-defined anchors, used inside tasks.

A task handles its rows in slices of bounded size; one document is never cut, so
a slice is at most ``SLICE_BYTES`` or one document long.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A prime modulus and base of a second hash: modulo a power of two, some built texts collide for any base.
_PRIME, _BASE_2 = (1 << 31) - 1, 0x2545F491
_INVERSE_2 = pow(_BASE_2, -1, _PRIME)
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random 64-bit number for every byte.
BYTES = mix((np.arange(256, dtype=U) + U(1)) * U(_BASE))
#: Bytes that end a word: the white space of the contracts, and (with ASCII signs) of plain words.
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, *range(9, 14)]] = True
SIGNS = np.array([not (chr(b).isalnum() and b < 128 or b >= 128) for b in range(256)])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, 0 to n."""
    def of(base: int) -> np.ndarray:
        out = np.full(n + 1, base, dtype=U)
        out[0] = 1
        return np.cumprod(out, dtype=U)

    return of(_BASE), of(_INVERSE)


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the second base and of its inverse modulo the prime, 0 to n."""
    def of(base: int) -> np.ndarray:
        out = np.ones(1, dtype=U)
        while len(out) <= n:
            out = np.concatenate([out, out * U(pow(base, len(out), _PRIME)) % U(_PRIME)])
        return out[: n + 1]

    return of(_BASE_2), of(_INVERSE_2)


_POWERS: list[tuple[np.ndarray, ...]] = []


def cached_powers(n: int) -> tuple[np.ndarray, ...]:
    if not _POWERS or len(_POWERS[0][0]) <= n:
        n = max(n, SLICE_BYTES + (1 << 16))
        _POWERS[:] = [powers(n) + prime_powers(n)]
    return _POWERS[0]


class Hashes:
    """Hashes of any run of tokens, from prefix sums.

    ``twice`` mixes in a second hash modulo a prime. It is for hashes that decide whether
    texts are equal: modulo a power of two alone, built texts collide.
    """

    def __init__(self, tokens: np.ndarray, twice: bool = False):
        power, self.inverse, second, self.second_inverse = cached_powers(len(tokens))
        self.sums = np.zeros(len(tokens) + 1, dtype=U)
        np.cumsum(tokens * power[: len(tokens)], out=self.sums[1:], dtype=U)
        self.second = None
        if twice:
            self.second = np.zeros(len(tokens) + 1, dtype=U)
            np.cumsum((tokens >> U(33)) * second[: len(tokens)] % U(_PRIME), out=self.second[1:], dtype=U)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of the tokens from ``start`` up to ``end``; lengths count."""
        length = (end - start).astype(U)
        found = (self.sums[end] - self.sums[start]) * self.inverse[start] + mix(length)
        if self.second is not None:
            found ^= mix((self.second[end] - self.second[start]) % U(_PRIME) * self.second_inverse[start] % U(_PRIME))
        return mix(found)

    def grams(self, k: int) -> np.ndarray:
        """The hash of every ``k`` tokens in a row."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


def slices(sizes: Sequence[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes, or of one row."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)
    release()


def release() -> None:
    """Give memory that is free back to the system: workers live on from stage to stage, and
    would keep what their largest slice took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text starts (one more entry for the end)."""
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), starts


class Words:
    """The words of some texts: ``start`` and ``end`` in the joined bytes, ``hash``,
    and ``first``, the index of each text's first word (one more entry for the end)."""

    def __init__(self, texts: Sequence[bytes], ends_word: np.ndarray = SPACES):
        data, _ = joined([t + b" " for t in texts])
        self.data = data
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        text_starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        inside = ~ends_word[data]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.start, self.end = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.start, text_starts)
        self.hash = Hashes(BYTES[data], twice=True).of(self.start, self.end) if len(data) else np.zeros(0, dtype=U)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    least, span = values, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span:])
    return least


class Anchors:
    """Runs of windows that share their anchor.

    A window of ``size`` tokens is anchored at the least of the hashed ``gram``
    tokens in it, the leftmost of equals. That place depends on the window's
    content only, so equal windows have equal anchors at equal distances. For
    each run of neighbouring windows with one anchor: ``text`` (row), ``at`` (the
    anchor), ``low`` and ``high`` (first and last window start), all relative to
    the text, ``key`` (hash at the anchor) and ``content`` (hash of everything the
    run's windows cover, and of the anchor's place in it).
    """

    def __init__(self, tokens: np.ndarray, first: np.ndarray, size: int, gram: int):
        n, lengths = len(tokens), np.diff(first)
        if not (lengths >= size).any():
            none = np.zeros(0, dtype=np.int64)
            self.text = self.at = self.low = self.high = none
            self.key = self.content = none.astype(U)
            return
        hashes = Hashes(tokens, twice=True)
        grams = hashes.grams(gram)
        bits = U(max(24, n.bit_length()))
        placed = (grams >> bits << bits) | np.arange(len(grams), dtype=U)
        anchor = (sliding_least(placed, size - gram + 1) & ((U(1) << bits) - U(1))).astype(np.int64)
        text = np.repeat(np.arange(len(lengths)), lengths)
        whole = text[: len(anchor)] == text[size - 1:]
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1])
        low = np.flatnonzero(new)
        last = whole.copy()
        last[:-1] &= ~whole[1:] | (anchor[1:] != anchor[:-1])
        high = np.flatnonzero(last)
        self.text = text[low]
        at = anchor[low]
        self.key = grams[at]
        self.content = mix(hashes.of(low, high + size) + mix((at - low).astype(U)))
        base = first[:-1][self.text]
        self.at, self.low, self.high = at - base, low - base, high - base
