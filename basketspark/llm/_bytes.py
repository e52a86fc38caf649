"""Texts as arrays of bytes: hashes of words and windows for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random value for each byte, an odd base of the polynomial and its inverse modulo 2^64.
CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and INVERSE^i for i below ``n``."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for at, x in enumerate((BASE, INVERSE)):
            made = np.full(size, x, np.uint64)
            made[0] = 1
            _powers[at] = np.multiply.accumulate(made)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = BASE^i * hash(buf[i:j])."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(CODE[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(np.uint64))


def batches(frame: pd.DataFrame, text: str = "text", limit: int = 1 << 18) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(rows, bytes, starts): consecutive rows of about ``limit`` bytes of text, a newline after each text.

    Text i is bytes[starts[i] : starts[i + 1] - 1]; null texts are empty.
    """
    own: list[bytes] = []
    size = first = 0
    last = len(frame) - 1
    for i, x in enumerate(frame[text]):
        own.append(b"" if x is None else bytes(x) if isinstance(x, bytes | bytearray) else x.encode("utf-8", "surrogatepass"))
        size += len(own[-1]) + 1
        if size >= limit or i == last:
            starts = np.zeros(len(own) + 1, np.int64)
            np.cumsum([len(x) + 1 for x in own], out=starts[1:])
            yield frame.iloc[first : i + 1], np.frombuffer(b"\n".join(own) + b"\n", np.uint8), starts
            own, size, first = [], 0, i + 1


def shingle_sets(buf: np.ndarray, starts: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct hashes of ``k`` consecutive words.

    A-Z are lower-cased; words are what stands between bytes 0x20 and 0x09 to 0x0D. A text
    of fewer words has its whole sequence as its only shingle, one without words has none.
    """
    low = buf + (((buf >= 65) & (buf <= 90)).astype(np.uint8) << 5)
    space = (low == 32) | ((low >= 9) & (low <= 13))
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word = span_hashes(prefix_hashes(low), begin, end)
    at = np.searchsorted(begin, starts)
    c = mix(np.arange(1, k + 1, dtype=np.uint64))
    full = np.zeros(max(0, len(word) - k + 1), np.uint64)
    for j in range(k):
        full += word[j : j + len(full)] * (c[j] | np.uint64(1))
    full = mix(full)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = hi - lo
        if n >= k:
            out.append(np.unique(full[lo : hi - k + 1]))
        elif n:
            short = sum(int(word[lo + j]) * int(c[j] | np.uint64(1)) for j in range(n)) + n * BASE
            out.append(mix(np.array([short % 2**64], np.uint64) ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
