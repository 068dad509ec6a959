"""Word splitting and hashing shared by the training-data operators, on UTF-8 bytes (so ASCII-only lower-casing is exact)."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
#: A-Z to a-z; digits, letters and all bytes above 0x7F stay; everything else separates.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
hash_word = xxhash.xxh3_64_intdigest


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def space_words(text: str | None, lower: bool = True) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, lower-cased A-Z when asked."""
    data = raw(text)
    return (data.lower() if lower else data).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return raw(text).translate(ALNUM).split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash_word, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word windows; fewer words but not none: the whole sequence as one; none: no window."""
    n = len(h)
    if n == 0:
        return h
    size = min(n, k)
    out = np.full(n - size + 1, size, U64)
    for i in range(size):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[i : n - size + 1 + i])
    return out
