"""Length-limited canonical prefix codes over bytes, with array operations where that pays."""

from __future__ import annotations

import heapq

import numpy as np

MAX_BITS = 15


def code_lengths(freq: list[int], limit: int = MAX_BITS) -> list[int]:
    """Optimal code lengths of at most ``limit`` bits; 0 for symbols that do not occur.

    A tree that is shallow enough gives them at once, else package-merge does.
    One symbol alone gets length 1, none at all gives no codes.
    """
    used = [s for s, n in enumerate(freq) if n]
    out = [0] * len(freq)
    if len(used) == 1:
        out[used[0]] = 1
    if len(used) < 2:
        return out
    heap = [(freq[s], i) for i, s in enumerate(used)]
    heapq.heapify(heap)
    parent = [0] * (2 * len(used) - 1)
    for node in range(len(used), 2 * len(used) - 1):
        (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a] = parent[b] = node
        heapq.heappush(heap, (n + m, node))
    depth = [0] * len(parent)
    for node in range(len(parent) - 2, -1, -1):
        depth[node] = depth[parent[node]] + 1
    if max(depth[: len(used)]) <= limit:
        for i, s in enumerate(used):
            out[s] = depth[i]
        return out
    coins = sorted((freq[s], (s,)) for s in used)
    level = coins
    for _ in range(limit - 1):
        packages = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = sorted(coins + packages, key=lambda x: x[0])
    for _, symbols in level[: 2 * len(used) - 2]:
        for s in symbols:
            out[s] += 1
    return out


def canonical_codes(lengths: list[int]) -> list[int]:
    """Codes in order of (length, symbol); raises if the lengths are over-subscribed."""
    out, code, before = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        if code >> n:
            raise ValueError("over-subscribed code lengths")
        out[s], before = code, n
        code += 1
    return out


def pack(data: bytes, lengths: list[int]) -> tuple[bytes, int]:
    """The bit stream, first bit highest, and the number of zero bits that pad its last byte."""
    if not data:
        return b"", 0
    symbols = np.frombuffer(data, np.uint8)
    n = np.array(lengths, np.int64)[symbols]
    if not n.all():
        raise ValueError("a symbol has no code")
    codes = np.array(canonical_codes(lengths), np.int64)[symbols]
    end = np.cumsum(n)
    owner = np.repeat(np.arange(len(symbols)), n)
    shift = end[owner] - 1 - np.arange(end[-1])
    bits = (codes[owner] >> shift & 1).astype(np.uint8)
    return np.packbits(bits).tobytes(), int(-end[-1] % 8)


def unpack(data: bytes, padding: int, lengths: list[int], size: int | None = None) -> bytes:
    """The symbols of a bit stream; raises if it ends inside a code or, with ``size`` given, too early."""
    total = len(data) * 8 - padding
    if padding > 7 or total < 0:
        raise ValueError("bad padding")
    if not total:
        if size:
            raise ValueError("bit stream ends too early")
        return b""
    table_symbol = np.zeros(1 << MAX_BITS, np.uint8)
    table_length = np.zeros(1 << MAX_BITS, np.int64)
    for s, (n, code) in enumerate(zip(lengths, canonical_codes(lengths), strict=True)):
        if n > MAX_BITS:
            raise ValueError("code too long")
        if n:
            lo = code << MAX_BITS - n
            table_symbol[lo : lo + (1 << MAX_BITS - n)] = s
            table_length[lo : lo + (1 << MAX_BITS - n)] = n
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    word = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    at = np.arange(total)
    seen = word[at >> 3] >> (24 - MAX_BITS - (at & 7)) & (1 << MAX_BITS) - 1
    symbol, step = table_symbol[seen].tobytes(), table_length[seen].tolist()
    out, p = bytearray(), 0
    while p < total and (size is None or len(out) < size):
        if not step[p]:
            raise ValueError("invalid code")
        out.append(symbol[p])
        p += step[p]
    if p > total or (size is not None and len(out) != size) or (size is not None and p != total):
        raise ValueError("bit stream does not end with a code")
    return bytes(out)
