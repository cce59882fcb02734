"""Sliding-window matching over bytes, and its token stream.

Matches are found for all positions of a block of chunks at once.  One match
length after the other, positions are sorted by a hash of that many bytes; the
neighbour before a position in that order is the nearest earlier place with the
same bytes.  The longest length with such a place within the window gives the
match, and a search on hashes its exact length.  The window is searched whole,
so there is no limit to the number of places looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Fixed values of the stream format: flags, shortest and longest match, largest offset that fits two bytes.
LITERAL, REFERENCE = 0, 1
MIN_MATCH, MAX_MATCH, MAX_OFFSET = 3, 255, 65_535
#: Lengths that are looked up, each within a third of the one before.
LEVELS = (3, 4, 5, 6, 8, 10, 13, 16, 20, 26, 32, 42, 56, 74, 98, 128, 170, 216, 255)
#: Chunks are searched together up to so many bytes.
BLOCK_BYTES = 1 << 17

Token = tuple[int, int, int, int]  # flag, byte, offset, length
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x94D049BB133111EB))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        for i, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers


def matches(chunks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each chunk the length and offset of the match at each position, 0 where there is none; no match leaves its chunk."""
    data = np.frombuffer(b"".join(chunks), np.uint8)
    size = np.array([len(c) for c in chunks])
    end = np.cumsum(size)
    n = len(data)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    chunk = np.repeat(np.arange(len(chunks)), size)
    left = np.minimum(end[chunk] - np.arange(n), MAX_MATCH)
    salt = _mix((chunk + 1).astype(np.uint64) * _BASE)
    length, source = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def spans(at: np.ndarray, k) -> np.ndarray:
        return (sums[at + k] - sums[at]) * down[at]

    low = np.uint64((1 << n.bit_length()) - 1)
    alive = np.arange(n)
    for k in LEVELS:
        alive = alive[left[alive] >= k]
        if len(alive) < 2:
            break
        # A hash with the place in its low bits: equal hashes lie in order of their places, and numbers sort faster than an index of them.
        h = np.sort((_mix(spans(alive, k)) ^ salt[alive]) & ~low | alive.astype(np.uint64))
        p = (h & low).astype(np.int64)
        same = (h[1:] ^ h[:-1]) <= low
        at, before = p[1:][same], p[:-1][same]
        near = at - before <= MAX_OFFSET
        length[at[near]], source[at[near]] = k, before[near]
        # Only places that are not alone go on to the next length.
        alive = np.sort(p[np.append(same, False) | np.insert(same, 0, False)])
    # The exact length lies between the level reached and the next one.
    at = np.flatnonzero(length)
    nxt = np.array([*LEVELS[1:], MAX_MATCH + 1])
    lo = length[at]
    hi = np.minimum(nxt[np.searchsorted(LEVELS, lo)] - 1, left[at])
    src = source[at]
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        equal = spans(at, mid) == spans(src, mid)
        lo, hi = np.where(equal, mid, lo), np.where(equal, hi, mid - 1)
    length[at] = lo
    offset = np.where(length > 0, np.arange(n) - source, 0)
    first = end - size
    return [(length[a:b], offset[a:b]) for a, b in zip(first, end, strict=True)]


def parse(data: bytes, length: np.ndarray, offset: np.ndarray, lazy: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Positions and lengths of the tokens that rebuild the data (length 0 for a literal).

    With ``lazy`` a match gives way to a literal if the next byte starts a longer one.
    """
    lengths, offsets = length.tolist(), offset.tolist()
    lengths.append(0)
    at, n = 0, len(data)
    where: list[int] = []
    what: list[int] = []
    while at < n:
        k = lengths[at]
        # Equal hashes are no proof; a match is taken only if its bytes are the same.
        if k < MIN_MATCH or (lazy and lengths[at + 1] > k) or data[at - offsets[at] : at - offsets[at] + k] != data[at : at + k]:
            where.append(at)
            what.append(0)
            at += 1
        else:
            where.append(at)
            what.append(k)
            at += k
    return np.array(where, np.int64), np.array(what, np.int64)


def write(data: bytes, where: np.ndarray, what: np.ndarray, offset: np.ndarray) -> bytes:
    """The stream: flag and byte of a literal, flag, offset (low byte first) and length of a reference."""
    if not len(where):
        return b""
    refs = what > 0
    size = np.where(refs, 4, 2)
    start = np.cumsum(size) - size
    out = np.zeros(int(start[-1] + size[-1]), np.uint8)
    out[start] = refs
    off = offset[where]
    out[start + 1] = np.where(refs, off & 255, np.frombuffer(data, np.uint8)[where])
    out[start[refs] + 2] = off[refs] >> 8
    out[start[refs] + 3] = what[refs]
    return out.tobytes()


def compress_all(chunks: list[bytes], lazy: bool = True) -> list[tuple[bytes, int, int]]:
    """(stream, literals, references) of each chunk; chunks are searched together in blocks."""
    out: list[tuple[bytes, int, int]] = []
    lo = 0
    while lo < len(chunks):
        hi, size = lo, 0
        while hi < len(chunks) and (hi == lo or size + len(chunks[hi]) <= BLOCK_BYTES):
            size += len(chunks[hi])
            hi += 1
        for c, (length, offset) in zip(chunks[lo:hi], matches(chunks[lo:hi]), strict=True):
            where, what = parse(c, length, offset, lazy)
            refs = int(np.count_nonzero(what))
            out.append((write(c, where, what, offset), len(what) - refs, refs))
        lo = hi
    return out


def compress(data: bytes, lazy: bool = True) -> bytes:
    return compress_all([data], lazy)[0][0]


def tokens(data: bytes, lazy: bool = True) -> Iterator[Token]:
    """Literals and references that rebuild the data."""
    return deserialize(compress(data, lazy))


def serialize(stream: Iterator[Token]) -> bytes:
    out = bytearray()
    for flag, byte, offset, length in stream:
        if flag == LITERAL:
            out += bytes((LITERAL, byte))
        else:
            out += bytes((REFERENCE, offset & 255, offset >> 8, length))
    return bytes(out)


def deserialize(stream: bytes) -> Iterator[Token]:
    """Raises ValueError for a truncated literal, a truncated reference or an unknown flag."""
    at, n = 0, len(stream)
    while at < n:
        flag = stream[at]
        if flag == LITERAL:
            if at + 1 >= n:
                raise ValueError("truncated literal")
            yield LITERAL, stream[at + 1], 0, 0
            at += 2
        elif flag == REFERENCE:
            if at + 3 >= n:
                raise ValueError("truncated reference")
            yield REFERENCE, 0, stream[at + 1] | stream[at + 2] << 8, stream[at + 3]
            at += 4
        else:
            raise ValueError("invalid token flag")


def expand(stream: Iterator[Token]) -> bytes:
    """The data a token stream stands for; a reference may overlap what it produces."""
    return decompress(serialize(stream))


def decompress(stream: bytes) -> bytes:
    """The data of a token stream, read in one go."""
    out = bytearray()
    at, n = 0, len(stream)
    while at < n:
        flag = stream[at]
        if flag == LITERAL:
            if at + 1 >= n:
                raise ValueError("truncated literal")
            out.append(stream[at + 1])
            at += 2
        elif flag == REFERENCE:
            if at + 3 >= n:
                raise ValueError("truncated reference")
            offset, length = stream[at + 1] | stream[at + 2] << 8, stream[at + 3]
            start = len(out) - offset
            if not offset or start < 0:
                raise ValueError("reference before the start")
            if offset >= length:
                out += out[start : start + length]
            else:
                out += (out[start:] * (length // offset + 1))[:length]
            at += 4
        else:
            raise ValueError("invalid token flag")
    return bytes(out)


def token_arrays(stream: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flags, bytes, offsets and lengths of the tokens of a stream; raises as ``deserialize`` does."""
    raw = np.frombuffer(stream + bytes(3), np.uint8).astype(np.int32)
    starts, at, n = [], 0, len(stream)
    while at < n:
        starts.append(at)
        flag = stream[at]
        if flag == LITERAL:
            at += 2
        elif flag == REFERENCE:
            at += 4
        else:
            raise ValueError("invalid token flag")
    if at > n:
        raise ValueError("truncated reference" if stream[starts[-1]] == REFERENCE else "truncated literal")
    at_ = np.array(starts, np.int64)
    flag = raw[at_]
    ref = flag == REFERENCE
    byte = np.where(ref, 0, raw[at_ + 1])
    offset = np.where(ref, raw[at_ + 1] | raw[np.minimum(at_ + 2, n + 2)] << 8, 0)
    length = np.where(ref, raw[np.minimum(at_ + 3, n + 2)], 0)
    return flag, byte, offset, length
