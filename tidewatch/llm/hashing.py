"""Vectorised hashes of words and byte spans; arithmetic wraps at 64 bits."""

from __future__ import annotations

import numpy as np
import pandas as pd

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray, k: int = 0) -> np.ndarray:
    """Scramble each 64-bit value; k picks one of several functions."""
    x = x ^ (x >> np.uint64(31 + k))
    x = x * ODD[3 - (k & 1)]
    x = x ^ (x >> np.uint64(29))
    x = x * ODD[1 + (k & 1)]
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit SipHash of each word, the same on every machine."""
    column = np.empty(len(words), object)
    column[:] = words
    return pd.util.hash_array(column, categorize=False)


def words_raw(text: str | None) -> list[bytes]:
    """Words as they are: runs of bytes other than space and \\t to \\r."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def words_lower(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
