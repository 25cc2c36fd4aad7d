"""Word shingles of whole texts as sorted 64-bit hashes, computed on Arrow's own buffers."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20  # bytes of text hashed at once; a longer text is a chunk of its own


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    codes = np.arange(256, dtype=np.uint64)
    lower = np.where((codes >= 65) & (codes <= 90), codes + np.uint64(32), codes)
    is_word = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
    return mix((lower + np.uint64(1)) * _STEP) * is_word, is_word


_powers: dict[str, np.ndarray] = {}


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if n > len(_powers.get("up", ())):
        size = max(n, _CHUNK + 1)
        base = 0x5851F42D4C957F2D
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            full = np.full(size, b, dtype=np.uint64)
            full[0] = 1
            _powers[name] = np.cumprod(full, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the row it is in. data: bytes of the rows, one after another."""
    values, is_word = _byte_tables()
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = is_word[data]
    first = np.zeros(n + 1, dtype=bool)  # where a row begins, words don't go on
    first[offsets] = True
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside[:n]
    starts = np.flatnonzero(inside & (~before | first))
    ends = np.flatnonzero(before & (~inside | first))
    up, down = _powers_of(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[:n], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)
    return h, np.searchsorted(offsets, starts, side="right") - 1


def _chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and row offsets of slices of about _CHUNK bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    _, places, buf = texts.buffers()
    at = np.frombuffer(places, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + _CHUNK, side="right")) - 1)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of `width` words as a sorted array; the whole word sequence as one shingle
    where there are fewer words; an empty array for null and for texts without words. A-Z count as a-z."""
    for _, data, offsets in _chunks(texts):
        words, row = _word_hashes(data, offsets)
        bounds = np.searchsorted(row, np.arange(len(offsets)))
        full = max(0, len(words) - width + 1)
        joined = words[:full].copy()
        for k in range(1, width):
            joined = mix(joined * _STEP + words[k : k + full])
        for i in range(len(offsets) - 1):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= width:
                yield np.unique(joined[a : b - width + 1])
            elif b > a:
                h = np.full(1, b - a, dtype=np.uint64)
                for k in range(a, b):
                    h = mix(h * _STEP + words[k : k + 1] + np.uint64(7))
                yield h
            else:
                yield np.zeros(0, np.uint64)


@functools.cache
def _families(t: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    s = mix((np.arange(1, 2 * t + 1, dtype=np.uint64) + np.uint64(seed * 1000)) * _STEP)
    return s[:t], s[t:] | np.uint64(1)


def minhash(shingles: np.ndarray, t: int, seed: int = 1) -> np.ndarray:
    """t independent minwise values of a set that isn't empty."""
    xor, times = _families(t, seed)
    best = None
    for i in range(0, len(shingles), 4096):
        low = ((shingles[i : i + 4096, None] ^ xor) * times).min(axis=0)
        best = low if best is None else np.minimum(best, low)
    return best
