"""A compressor over characters: short-window matching, prefix codes, JSON code book."""

from __future__ import annotations

import ast
import heapq
import json
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chars import ratio, saving_percent

# Fixed values of the format: big-endian counts of characters, tokens, symbols and padding bits; then the code book.
HEAD = struct.Struct(">IIII")
WINDOW, MAX_MATCH, MIN_MATCH = 255, 255, 3

Token = tuple[str, str, int, int]  # kind ("L" or "R"), character, offset, length


#: Characters that are searched together.
BLOCK_CHARS = 1 << 16


def matches(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the longest match at each position and its offset, 0 where none has three characters.

    For each offset of the window the run of equal characters from every
    position on is known at once; offsets are tried from the farthest, so of
    equal matches the farthest wins.  A match may run into what it produces.
    """
    joined = "".join(t + "\n" for t in texts)
    size = np.array([len(t) + 1 for t in texts])
    own = np.repeat(np.arange(len(texts), dtype=np.int64) << 21, size)
    # A line feed of its own number ends each text, so no run reaches into the next one.
    value = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + own
    end = np.cumsum(size)
    value[end - 1] = -1 - np.arange(len(texts))
    n = len(value)
    best, offset = np.zeros(n, np.int32), np.zeros(n, np.int32)
    place = np.arange(n, dtype=np.int32)
    for d in range(min(WINDOW, n - 1), 0, -1):
        stop = np.where(value[d:] == value[:-d], np.int32(n), place[d:])
        run = np.minimum.accumulate(stop[::-1])[::-1] - place[d:]
        np.minimum(run, MAX_MATCH, out=run)
        more = run > best[d:]
        best[d:][more] = run[more]
        offset[d:][more] = d
    short = best < MIN_MATCH
    best[short] = offset[short] = 0
    return [(best[a : b - 1], offset[a : b - 1]) for a, b in zip(end - size, end, strict=True)]


def tokens(text: str) -> list[Token]:
    """Of equal matches the farthest in the window wins; a match may run into what it produces."""
    return tokens_of([text])[0]


def tokens_of(texts: list[str]) -> list[list[Token]]:
    """The tokens of each text; texts are searched together in blocks."""
    out: list[list[Token]] = []
    lo = 0
    while lo < len(texts):
        hi, chars = lo, 0
        while hi < len(texts) and (hi == lo or chars + len(texts[hi]) < BLOCK_CHARS):
            chars += len(texts[hi]) + 1
            hi += 1
        for text, (best, offset) in zip(texts[lo:hi], matches(texts[lo:hi]), strict=True):
            length, off = best.tolist(), offset.tolist()
            at, n, stream = 0, len(text), []
            while at < n:
                k = length[at]
                if k:
                    stream.append(("R", "", off[at], k))
                    at += k
                else:
                    stream.append(("L", text[at], 0, 0))
                    at += 1
            out.append(stream)
        lo = hi
    return out


def expand(stream: list[Token]) -> str:
    out: list[str] = []
    for kind, c, offset, length in stream:
        if kind == "L":
            out.append(c)
            continue
        start = len(out) - offset
        if not offset or start < 0:
            raise ValueError("reference before the start")
        out += out[start : start + length] if offset >= length else (out[start:] * (length // offset + 1))[:length]
    return "".join(out)


def to_symbols(stream: list[Token]) -> list[str]:
    out: list[str] = []
    for kind, c, offset, length in stream:
        out += ("L", c) if kind == "L" else ("R", chr(offset), chr(length))
    return out


def from_symbols(symbols: list[str]) -> list[Token]:
    out: list[Token] = []
    it = iter(symbols)
    try:
        for kind in it:
            if kind == "L":
                out.append(("L", next(it), 0, 0))
            elif kind == "R":
                out.append(("R", "", ord(next(it)), ord(next(it))))
            else:
                raise ValueError("unknown token kind")
    except StopIteration:
        raise ValueError("truncated token") from None
    return out


def code_book(symbols: list[str]) -> dict[str, str]:
    """An optimal prefix code; ties by symbol, so it is the same everywhere."""
    freq = Counter(symbols)
    if len(freq) < 2:
        return dict.fromkeys(freq, "0")
    depth: Counter[str] = Counter()
    heap = [(n, s, (s,)) for s, n in sorted(freq.items())]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        depth.update(a[2] + b[2])
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in depth.items()):
        code <<= n - before
        out[s], before = format(code, f"0{n}b"), n
        code += 1
    return out


def compress(text: str) -> bytes:
    """Empty text has an empty code book and no payload."""
    return packed(text, tokens(text))


def packed(text: str, stream: list[Token]) -> bytes:
    symbols = to_symbols(stream)
    book = code_book(symbols)
    bits = "".join([book[s] for s in symbols])
    padding = -len(bits) % 8
    payload = int(bits + "0" * padding, 2).to_bytes((len(bits) + padding) // 8, "big") if bits else b""
    block = json.dumps({repr(s): c for s, c in book.items()}).encode()
    return HEAD.pack(len(text), len(stream), len(symbols), padding) + struct.pack(">I", len(block)) + block + payload


#: Codes up to so many bits are decoded by a table of all bit patterns, longer ones bit by bit.
TABLE_BITS = 16


def _symbols(payload: bytes, padding: int, book: dict[str, str], count: int) -> list[str]:
    """The first ``count`` symbols of a bit stream."""
    total = len(payload) * 8 - padding
    if padding > 7 or total < 0:
        raise ValueError("bad padding")
    width = max(map(len, book), default=0)
    out: list[str] = []
    p = 0
    if 0 < width <= TABLE_BITS:
        names, step = list(book.values()), np.zeros(1 << width, np.int64)
        which = np.zeros(1 << width, np.int64)
        for i, code in enumerate(book):
            lo = int(code, 2) << width - len(code)
            step[lo : lo + (1 << width - len(code))] = len(code)
            which[lo : lo + (1 << width - len(code))] = i
        raw = np.frombuffer(payload + b"\0\0\0", np.uint8).astype(np.int64)
        word = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        at = np.arange(total)
        seen = word[at >> 3] >> (24 - width - (at & 7)) & (1 << width) - 1
        steps, found = step[seen].tolist(), which[seen].tolist()
        while len(out) < count:
            if p >= total or not steps[p] or p + steps[p] > total:
                raise ValueError("invalid code")
            out.append(names[found[p]])
            p += steps[p]
        return out
    bits = format(int.from_bytes(payload, "big"), f"0{len(payload) * 8}b")[:total] if payload else ""
    while len(out) < count:
        for k in range(1, width + 1):
            s = book.get(bits[p : p + k]) if p + k <= total else None
            if s is not None:
                out.append(s)
                p += k
                break
        else:
            raise ValueError("invalid code")
    return out


def decompress(data: bytes) -> str:
    """Raises ValueError for anything but an intact stream; the code book is parsed, never evaluated."""
    try:
        size, n_tokens, n_symbols, padding = HEAD.unpack_from(data)
        (length,) = struct.unpack_from(">I", data, HEAD.size)
        at = HEAD.size + 4
        book = {code: ast.literal_eval(key) for key, code in json.loads(data[at : at + length].decode()).items()}
    except (struct.error, SyntaxError, UnicodeDecodeError) as e:
        raise ValueError("broken header") from e
    stream = from_symbols(_symbols(data[at + length :], padding, book, n_symbols))
    text = expand(stream)
    if len(text) != size or len(stream) != n_tokens:
        raise ValueError("sizes do not add up")
    return text


def _each(values: pa.Array, work) -> list:
    """``work`` on the values that are not null."""
    done = iter(work([t for t in values.to_pylist() if t is not None]))
    return [next(done) if there else None for there in values.is_valid().to_pylist()]


@F.arrow_udf(T.BinaryType())
def compress_column(text: pa.Array) -> pa.Array:
    return pa.array(_each(text, lambda texts: map(packed, texts, tokens_of(texts))), pa.binary())


@F.arrow_udf(T.StringType())
def decompress_column(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else decompress(d) for d in data.to_pylist()], pa.string())


_STATS = T.StructType([T.StructField(n, T.BooleanType() if n == "same" else T.LongType()) for n in ("text_bytes", "compressed_bytes", "literals", "refs", "same")])


@F.arrow_udf(_STATS)
def statistics_column(text: pa.Array) -> pa.Array:
    """Sizes, token counts and whether the round trip gives the text back."""

    def work(texts: list[str]):
        for t, stream in zip(texts, tokens_of(texts), strict=True):
            z, kinds = packed(t, stream), Counter(x[0] for x in stream)
            yield {"text_bytes": len(t.encode()), "compressed_bytes": len(z), "literals": kinds["L"], "refs": kinds["R"], "same": decompress(z) == t}

    return pa.array(_each(text, work), pa.struct([("text_bytes", pa.int64()), ("compressed_bytes", pa.int64()), ("literals", pa.int64()), ("refs", pa.int64()), ("same", pa.bool_())]))


# --- files ----------------------------------------------------------------


def compress_files(files: DataFrame) -> DataFrame:
    """(path, content, text_bytes, compressed_bytes, ratio, saving_pct, same) from (path, text); a file whose round trip fails has no content."""
    s = files.select("path", compress_column("text").alias("z"), "text")
    same = decompress_column("z") == F.col("text")
    n, m = F.octet_length("text").cast("long"), F.octet_length("z").cast("long")
    return s.select("path", F.when(same, F.col("z")).alias("content"), n.alias("text_bytes"), m.alias("compressed_bytes"), ratio(m, n).alias("ratio"), saving_percent(m, n).alias("saving_pct"), same.alias("same"))
