"""Texts as arrays of code points: lower-case letters and digits, one space between runs of them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

STOP = 1  # U+0000 stands between documents in a buffer
SPACE = 32


@lru_cache(maxsize=1)
def kept() -> np.ndarray:
    """For each code point itself if it is a letter or digit, STOP for U+0000, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        if not 0xD800 <= point < 0xE000 and chr(point).isalnum():
            table[point] = point
    table[0] = STOP
    return table


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes with SPACE for each run of other characters, and the place of each in lower-cased text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = kept()[points]
    keep = codes != 0
    if len(keep):
        keep[1:] |= codes[:-1] != 0
    at = np.flatnonzero(keep)
    codes = codes[at]
    codes[codes == 0] = SPACE
    return codes, at


def lowered(text: str) -> str:
    """Lower case with as many characters, so that places hold in the original."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
