"""Vectorized text kernel: code-point arrays, word hashes, rolling hashes.

Everything works on *blocks*: some texts joined into one code-point array, so
numpy sees long arrays instead of many short ones.  Blocks are bounded in
characters, so memory per worker is bounded by the block limit plus the
longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BLOCK_CHARS = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (splitmix64), wrapping arithmetic."""
    x = x.astype(_U, copy=True)
    x += _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its modular inverse, for i < n, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, BLOCK_CHARS + 1)
        up, down = np.full(n, base, _U), np.full(n, pow(base, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        have = _powers[base] = (up, down)
    return have


def blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` characters in all."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a line feed, and the start of each (n + 1 entries)."""
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=start[1:])
    return cp, start


@lru_cache(1)
def alnum_table() -> np.ndarray:
    """Whether each code point is a letter or digit (by rule, from the Unicode database of Python)."""
    out = np.zeros(0x110000, bool)
    for a, b in ((0, 0x3400), (0xA000, 0xAC00), (0xD7A0, 0xD800), (0xF900, 0x18D09), (0x1AFF0, 0x20000)):
        out[a:b] = [chr(c).isalnum() for c in range(a, b)]
    out[0x3400:0x4DC0] = out[0x4E00:0xA000] = out[0xAC00:0xD7A4] = True
    for c in (0x20000, 0x2A700, 0x2B740, 0x2B820, 0x2CEB0, 0x2F800, 0x30000):  # each plane of ideographs
        out[c : c + 0x10000 if c == 0x20000 else c + 1] = True
    out[0x20000:0x323B0] = True
    return out


@lru_cache(1)
def _mixed() -> np.ndarray:
    return mix64(np.arange(0x110000))


def prefix_hash(cp: np.ndarray, base: int = _BASE) -> np.ndarray:
    """n + 1 prefix sums of mix64(code point) * base**position."""
    out = np.zeros(len(cp) + 1, _U)
    np.multiply(_mixed()[cp], powers(len(cp) + 1, base)[0][: len(cp)], out=out[1:])
    np.cumsum(out, out=out)
    return out


def span_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Position-independent hash of values[a:b]."""
    return (prefix[b] - prefix[a]) * powers(len(prefix), base)[1][a]


class Words:
    """The words (unbroken runs of letters and digits) of a block of texts, hashed.

    ``hash``: a 64-bit hash of each word; ``doc``: the index of its text;
    ``first``: for each text the index of its first word (n + 1 entries);
    ``begin``/``end``: code-point positions within the block.
    """

    def __init__(self, texts: list[str]):
        cp, self.start = codes(texts)
        self.cp = cp
        word = alnum_table()[cp]
        edge = np.diff(word.astype(np.int8), prepend=np.int8(0))
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hash = mix64(span_hash(prefix_hash(cp), self.begin, self.end) + (self.end - self.begin).astype(_U))
        self.first = np.searchsorted(self.begin, self.start)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every k consecutive words within a text, and the index of its text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        whole = self.doc[:n] == self.doc[k - 1 :]
        h = np.zeros(n, _U)
        for j in range(k):
            h *= _U(0xD6E8FEB86659FD93)
            h += self.hash[j : j + n]
        return mix64(h[whole]), self.doc[:n][whole]


def distinct_by_doc(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, sorted within it; doc must be ascending."""
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[keep], d[keep]


def letters_hash(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text two independent hashes of its letters and digits in order, and their number."""
    n = len(texts)
    h1, h2, count = np.zeros(n, _U), np.zeros(n, _U), np.zeros(n, np.int64)
    for lo, hi in blocks(texts):
        cp, start = codes(texts[lo:hi])
        word = alnum_table()[cp]
        at = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(word, out=at[1:])
        a = at[start]
        kept = cp[word]
        count[lo:hi] = np.diff(a)
        h1[lo:hi] = mix64(span_hash(prefix_hash(kept), a[:-1], a[1:]))
        other = 0xC2B2AE3D27D4EB4F
        h2[lo:hi] = mix64(span_hash(prefix_hash(kept, other), a[:-1], a[1:], other))
    return h1, h2, count


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values (two-pass block method, linear time)."""
    n = len(values)
    if n < w:
        return values[:0]
    pad = -n % w
    x = np.concatenate([values, np.full(pad, values.max(), values.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])
