"""Word-shingle sets as sorted 64-bit hashes, computed inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of each word of UTF-8 bytes, A-Z lowered; bytes.split() parts at exactly the ASCII white space."""
    words = text.lower().split()
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word `width`-grams; fewer words: the whole sequence as one; none: empty."""
    words = word_hashes(text or b"")
    n = len(words)
    if not n:
        return words
    k = min(n, width)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out += words[i : n - k + 1 + i] * _MULTIPLIERS[i]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x7FB5D329728EA185)
        out ^= out >> np.uint64(27)
    return np.unique(out)
