import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.operators import charcodec, container, huffman, lz77
from tokenloom.plans.config import CodecConfig

SAMPLES = [
    b"",
    b"A",
    b"ab" * 12,
    b"The quick brown fox jumps over the lazy dog.",
    b"for(int i=0;i<n;i++){sum+=arr[i];}\nreturn sum;\n",
    b"A" * 10_000 + b"B" * 10_000,
    bytes(range(256)),
    b"x" * 255 + b"y" + b"x" * 255,
]


@pytest.mark.parametrize("data", SAMPLES)
@pytest.mark.parametrize("lazy", [True, False])
def test_round_trip(data, lazy):
    assert container.decompress(container.compress(data, CodecConfig(lazy=lazy))) == data


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600), st.integers(1, 300))
def test_round_trip_of_anything(data, chunk):
    packed = container.compress(data, CodecConfig(chunk_size=chunk))
    size, chunk_size, chunks = container.parse(packed)
    assert (size, chunk_size, len(chunks)) == (len(data), chunk, max(1, -(-len(data) // chunk)))
    assert len(packed) == 24 + 265 * len(chunks) + sum(len(c.data) for c in chunks)
    assert container.decompress(packed) == data


def test_empty_is_one_empty_chunk():
    assert len(container.compress(b"")) == 289


def test_offsets_fit_two_bytes():
    block = random.Random(5).randbytes(65_536)
    found = list(lz77.tokens(block + block + b"!" + block))
    assert max(t[2] for t in found) <= lz77.MAX_OFFSET
    assert lz77.expand(iter(found)) == block + block + b"!" + block


def test_lazy_matching_fires():
    data = b"abc bcdef abcdef"
    refs = lambda lazy: [t for t in lz77.tokens(data, lazy) if t[0]]
    assert max(t[3] for t in refs(True)) > max(t[3] for t in refs(False))


def test_overlapping_reference():
    assert lz77.expand(iter([(0, 97, 0, 0), (0, 98, 0, 0), (1, 0, 2, 5)])) == b"abababa"


@pytest.mark.parametrize("stream", [b"\0", b"\1\1\0", b"\2a", b"\1\1\0\3"])
def test_broken_token_streams(stream):
    with pytest.raises(ValueError):
        lz77.decompress(stream)


def test_length_limit_and_optimality():
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    lengths = huffman.code_lengths(fib)
    assert max(lengths) == 15 and sum(2.0**-n for n in lengths) <= 1
    data = b"".join(bytes([i]) * min(n, 50) for i, n in enumerate(fib))
    packed, padding = huffman.pack(data, lengths + [0] * 226)
    assert huffman.unpack(packed, padding, lengths + [0] * 226, len(data)) == data


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=2, max_size=40))
def test_cost_equals_the_unlimited_optimum_where_shallow(freq):
    import heapq

    heap, cost = list(freq), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert sum(f * n for f, n in zip(freq, huffman.code_lengths(freq), strict=True)) == cost


def test_corruption_is_an_error():
    packed = bytearray(container.compress(b"hello hello hello hello"))
    for broken in (packed[:20], packed[:-1], b"x" + packed[1:], packed + b"!"):
        with pytest.raises(container.CorruptContainer):
            container.decompress(bytes(broken))
    wrong = bytearray(packed)
    wrong[8] += 1
    with pytest.raises(container.CorruptContainer):
        container.decompress(bytes(wrong))


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=300))
def test_character_codec(text):
    assert charcodec.decompress(charcodec.compress(text)) == text


def test_character_codec_never_evaluates():
    packed = charcodec.compress("aaaa")
    evil = packed.replace(b"'L'", b"f()")
    with pytest.raises(ValueError):
        charcodec.decompress(evil)


def test_frames(spark):
    rows = [(1, bytearray(b"ab" * 3000)), (2, bytearray(b"")), (3, None)]
    df = spark.createDataFrame(rows, "id long, content binary")
    cfg = CodecConfig(chunk_size=1000)
    chunks = container.compressed_chunks(df, cfg)
    packed = {r.id: bytes(r.container) for r in container.containers(chunks, 1000).collect()}
    assert {i: container.decompress(p) for i, p in packed.items()} == {1: b"ab" * 3000, 2: b""}
    back = container.join(container.split(df, 1000))
    assert {r.id: bytes(r.content) for r in back.collect()} == {1: b"ab" * 3000, 2: b""}
    stats = {r.id: r for r in container.statistics(chunks).collect()}
    assert stats[1].num_chunks == 6 and stats[1].compressed_bytes == len(packed[1]) and stats[1].lz77_refs > 0
    assert stats[2].ratio is None and stats[2].num_chunks == 1
    assert {r.byte: r.n for r in container.byte_histogram(df).collect()} == {97: 3000, 98: 3000}


def test_sql_functions(spark):
    from tokenloom.functions.register import register

    register(spark)
    row = spark.sql("select char_decompress(char_compress('abcabcabc')) as a, cast(lz_decompress(lz_compress(encode('xyz', 'UTF-8'))) as string) as b, split_csv_line('a,\"b,c\"') as c").first()
    assert (row.a, row.b, row.c) == ("abcabcabc", "xyz", ["a", "b,c"])
    assert spark.createDataFrame([("é",)], "t string").select(F.octet_length(charcodec.compress_column("t"))).first()[0] > 16


def test_matches_far_back_and_lazy_steps_over_long_matches():
    far = b"abcdefghijklmnop" + b"".join(b"abc" + bytes([200 + i]) for i in range(40)) + b"abcdefghijklmnop"
    assert list(lz77.tokens(far))[-1][3] == 16
    first, more = bytes(range(100, 140)), bytes(range(140, 170))
    stream = list(lz77.tokens(first + b"!" + first[1:] + more + b"?" + first + more))
    assert stream[-1][3] == 69 and stream[-2] == (lz77.LITERAL, 100, 0, 0)
    assert lz77.expand(iter(stream)).endswith(b"?" + first + more)


def chained(data, depth):
    """Matches as a search along chains of the nearest places with three equal bytes finds them."""
    seen, out = {}, []
    for at in range(len(data)):
        best = 0
        for c in reversed(seen.get(data[at : at + 3], [])[-depth:]):
            n = 0
            while n < min(255, len(data) - at) and data[c + n] == data[at + n]:
                n += 1
            best = max(best, n)
        out.append(best if best >= 3 else 0)
        seen.setdefault(data[at : at + 3], []).append(at)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_matches_are_nearly_as_long_as_those_of_a_full_search(seed):
    rng = random.Random(seed)
    words = [bytes(rng.choices(range(97, 105), k=rng.randint(2, 9))) for _ in range(40)]
    chunks = [b" ".join(rng.choices(words, k=rng.choice([0, 1, 60, 300]))) for _ in range(5)] + [b"z" * 700]
    for data, (length, offset) in zip(chunks, lz77.matches(chunks), strict=True):
        full = chained(data, 10**9)
        for at, (n, off) in enumerate(zip(length.tolist(), offset.tolist(), strict=True)):
            assert data[at - off : at - off + n] == data[at : at + n] and (n > 0) == (full[at] > 0)
            assert full[at] >= n >= 0.74 * full[at] - 1
        assert sum(length) >= 0.93 * sum(full) and sum(length) >= 0.93 * sum(chained(data, 64))


def test_token_rows_are_read_from_the_stream(spark):
    data = b"abcabcabcabc!" * 30
    rows = spark.createDataFrame([(1, bytearray(container.compress(data, CodecConfig(chunk_size=100)))), (2, bytearray(container.compress(b"")))], "id long, container binary")
    got = container.token_rows(rows).orderBy("id", "chunk_idx", "pos").collect()
    parts = {}
    for r in got:
        parts.setdefault(r.chunk_idx, []).append((r.flag, r.byte_val, r.offset, r.length))
    assert {r.id for r in got} == {1} and b"".join(lz77.expand(iter(parts[i])) for i in sorted(parts)) == data
    shown = container.token_rows(rows).select(container.token_text(F.col("flag"), F.col("byte_val"), F.col("offset"), F.col("length")).alias("t")).limit(4).collect()
    assert [r.t for r in shown] == ["Lit(97)", "Lit(98)", "Lit(99)", "Ref(offset=3, len=9)"]


def by_hand(text):
    """Every offset tried at every position, from the far end of the window on; strictly longer matches only."""
    out, at = [], 0
    while at < len(text):
        best, offset = 0, 0
        for start in range(max(0, at - 255), at):
            n = 0
            while n < 255 and at + n < len(text) and text[start + n] == text[at + n]:
                n += 1
            if n > best:
                best, offset = n, at - start
        out.append(("R", "", offset, best) if best >= 3 else ("L", text[at], 0, 0))
        at += best if best >= 3 else 1
    return out


@pytest.mark.parametrize("block", [30, 1 << 16])
def test_character_matches_equal_a_plain_search(monkeypatch, block):
    monkeypatch.setattr(charcodec, "BLOCK_CHARS", block)
    rng = random.Random(block)
    texts = ["".join(rng.choice("abé😀\n") for _ in range(rng.choice([0, 1, 5, 60, 700]))) for _ in range(25)] + ["a" * 600, "abc" * 200, "\n" * 9]
    assert charcodec.tokens_of(texts) == [by_hand(t) for t in texts]


def test_long_codes_are_read_bit_by_bit(monkeypatch):
    text = "".join(chr(97 + i) * (1 << i) for i in range(12)) + "xyz" * 5
    packed = charcodec.compress(text)
    monkeypatch.setattr(charcodec, "TABLE_BITS", 2)
    assert charcodec.decompress(packed) == text and charcodec.compress(text) == packed
    with pytest.raises(ValueError):
        charcodec.decompress(packed[:-1])


def test_character_files(spark):
    rows = charcodec.compress_files(spark.createDataFrame([("a", "ab" * 500), ("b", ""), ("c", None)], "path string, text string")).collect()
    got = {r.path: r for r in rows}
    assert got["a"].same and got["a"].saving_pct > 50 and charcodec.decompress(bytes(got["a"].content)) == "ab" * 500
    assert got["b"].same and got["b"].ratio is None and got["c"].content is None


def test_token_rows_leave_in_bounded_batches(spark, monkeypatch):
    """A batch is sent on once it holds enough tokens; chunks, empty and null containers keep their places."""
    monkeypatch.setattr(container, "BATCH_TOKENS", 50)
    texts = [random.Random(i).randbytes(40 * i) for i in range(12)]
    sizes = []
    kept = container.pa.RecordBatch.from_arrays

    class Counted:
        @staticmethod
        def from_arrays(*a, **k):
            out = kept(*a, **k)
            sizes.append(out.num_rows)
            return out

    rows = container.token_reader()
    monkeypatch.setattr(container.pa, "RecordBatch", Counted)
    packed = [container.compress(t, CodecConfig(chunk_size=100)) for t in texts] + [None]
    out = list(rows([kept([container.pa.array(range(13)), container.pa.array(packed, container.pa.binary())], names=["id", "container"])]))
    assert len(out) == len(sizes) > 20 and max(sizes) < 50 + 100
    flat = [r for b in out for r in b.to_pylist()]
    for i, t in enumerate(texts):
        own = [r for r in flat if r["id"] == i]
        assert lz77.expand(iter([(r["flag"], r["byte_val"], r["offset"], r["length"]) for r in own])) == t
        assert [(r["chunk_idx"], r["pos"]) for r in own] == sorted((r["chunk_idx"], r["pos"]) for r in own)
    for bad in (b"\0", b"\1ab", b"\2"):
        with pytest.raises(ValueError):
            lz77.token_arrays(bad)


def test_chunks_are_compressed_in_bounded_slices(spark, monkeypatch):
    """However large a batch is, Python holds a slice of it; null and empty chunks keep their places."""
    monkeypatch.setattr(container, "SLICE_BYTES", 1000)
    seen = []
    kept = container.compress_chunks
    monkeypatch.setattr(container, "compress_chunks", lambda chunks, cfg: seen.append(chunks) or kept(chunks, cfg))
    texts = [None if i % 7 == 3 else random.Random(i).randbytes(i * 13 % 1500) for i in range(90)]
    out = container.chunk_encoder().func(container.pa.array(texts, container.pa.binary())).to_pylist()
    assert max(len(c) == 1 or sum(map(len, c)) for c in seen) <= 1000 and len(seen) > 20 and sum(seen, []) == [t for t in texts if t is not None]
    for t, z in zip(texts, out, strict=True):
        assert z is None if t is None else container.decompress_chunk(container.Chunk(**z)) == t
    assert container.chunk_encoder().func(container.pa.array([], container.pa.binary())).to_pylist() == []
