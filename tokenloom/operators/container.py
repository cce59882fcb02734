"""Chunked byte compression of DataFrames and the container format."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chars import ratio, saving_percent
from ..plans.config import CodecConfig
from . import huffman, lz77

# Fixed values of the format, all integers little-endian: magic, u64 size, u32 chunks, u32 chunk size;
# per chunk u32 compressed size, u32 original size, u8 padding, 256 code lengths, data.
MAGIC = b"CLM\x01\x00\x00\x00\x00"
HEAD, CHUNK_HEAD = struct.Struct("<8sQII"), struct.Struct("<IIB256s")
_PART = (("orig_size", T.LongType()), ("padding", T.IntegerType()), ("lengths", T.BinaryType()), ("data", T.BinaryType()))
CHUNK_TYPE = T.StructType([T.StructField(*f) for f in (*_PART, ("literals", T.LongType()), ("refs", T.LongType()))])
PARSED_TYPE = T.ArrayType(T.StructType([T.StructField(*f) for f in (("chunk_idx", T.IntegerType()), *_PART)]))


class Chunk(NamedTuple):
    orig_size: int
    padding: int
    lengths: bytes
    data: bytes
    literals: int = 0
    refs: int = 0


class CorruptContainer(ValueError):
    """The bytes are no intact container."""


def compress_chunks(chunks: list[bytes], cfg: CodecConfig = CodecConfig()) -> list[Chunk]:
    out = []
    for data, (stream, literals, refs) in zip(chunks, lz77.compress_all(chunks, cfg.lazy), strict=True):
        lengths = huffman.code_lengths(np.bincount(np.frombuffer(stream, np.uint8), minlength=256).tolist())
        packed, padding = huffman.pack(stream, lengths)
        out.append(Chunk(len(data), padding, bytes(lengths), packed, literals, refs))
    return out


def compress_chunk(data: bytes, cfg: CodecConfig = CodecConfig()) -> Chunk:
    return compress_chunks([data], cfg)[0]


def chunk_stream(chunk: Chunk) -> bytes:
    """The token stream a chunk holds."""
    try:
        return huffman.unpack(chunk.data, chunk.padding, list(chunk.lengths))
    except ValueError as e:
        raise CorruptContainer(str(e)) from e


def decompress_chunk(chunk: Chunk) -> bytes:
    """Raises CorruptContainer unless exactly the original number of bytes comes out."""
    try:
        out = lz77.decompress(chunk_stream(chunk))
    except ValueError as e:
        raise CorruptContainer(str(e)) from e
    if len(out) != chunk.orig_size:
        raise CorruptContainer(f"{len(out)} bytes instead of {chunk.orig_size}")
    return out


def serialize(chunks: list[Chunk], size: int, chunk_size: int) -> bytes:
    parts = [HEAD.pack(MAGIC, size, len(chunks), chunk_size)]
    for c in chunks:
        parts += CHUNK_HEAD.pack(len(c.data), c.orig_size, c.padding, c.lengths), c.data
    return b"".join(parts)


def parse(data: bytes) -> tuple[int, int, list[Chunk]]:
    """(original size, chunk size, chunks)."""
    if len(data) < HEAD.size:
        raise CorruptContainer("too short for a container")
    magic, size, n, chunk_size = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise CorruptContainer("wrong magic")
    at, chunks = HEAD.size, []
    for _ in range(n):
        if at + CHUNK_HEAD.size > len(data):
            raise CorruptContainer("truncated chunk header")
        packed, orig, padding, lengths = CHUNK_HEAD.unpack_from(data, at)
        at += CHUNK_HEAD.size
        if at + packed > len(data):
            raise CorruptContainer("truncated chunk")
        chunks.append(Chunk(orig, padding, lengths, data[at : at + packed]))
        at += packed
    if at != len(data) or sum(c.orig_size for c in chunks) != size:
        raise CorruptContainer("sizes do not add up")
    return size, chunk_size, chunks


def compress(data: bytes, cfg: CodecConfig = CodecConfig()) -> bytes:
    """One container; empty input has one empty chunk."""
    cuts = range(0, max(len(data), 1), cfg.chunk_size)
    return serialize(compress_chunks([data[i : i + cfg.chunk_size] for i in cuts], cfg), len(data), cfg.chunk_size)


def decompress(data: bytes) -> bytes:
    return b"".join(map(decompress_chunk, parse(data)[2]))


# --- DataFrames -----------------------------------------------------------


def split(df: DataFrame, chunk_size: int = CodecConfig.chunk_size, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """(id, size, chunk_idx, chunk): fixed chunks of a binary column; an empty value has one empty chunk, null none."""
    n = F.greatest(F.ceil(F.octet_length(content_col) / F.lit(float(chunk_size))), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(content_col), i * chunk_size + 1, F.lit(chunk_size)))
    rows = df.where(F.col(content_col).isNotNull())
    return rows.select(F.col(id_col).alias("id"), F.octet_length(content_col).cast("long").alias("size"), F.posexplode(parts).alias("chunk_idx", "chunk"))


def join(chunks: DataFrame) -> DataFrame:
    """(id, content) from (id, chunk_idx, chunk), in order; the chunks of a file fit a binary value as the file did."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk_idx", "chunk")))
    return chunks.groupBy("id").agg(ordered.alias("c")).select("id", F.aggregate("c", F.lit(b""), lambda acc, x: F.concat(acc, x["chunk"])).alias("content"))


#: Chunks of a batch are compressed in slices of so many bytes, so what Python holds does not grow with the batch.
SLICE_BYTES = 1 << 20


def slices(values: pa.Array) -> Iterator[pa.Array]:
    """Consecutive parts of a binary column that hold about SLICE_BYTES each, at least one value."""
    total = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(values):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield values.slice(at, end - at)
        at = end


def chunk_encoder(cfg: CodecConfig = CodecConfig()):
    kinds = pa.struct([("orig_size", pa.int64()), ("padding", pa.int32()), ("lengths", pa.binary()), ("data", pa.binary()), ("literals", pa.int64()), ("refs", pa.int64())])

    def encode(part: pa.Array) -> pa.Array:
        done = iter(compress_chunks(part.drop_null().to_pylist(), cfg))
        return pa.array([next(done)._asdict() if there else None for there in part.is_valid().to_pylist()], kinds)

    @F.arrow_udf(CHUNK_TYPE)
    def run(chunk: pa.Array) -> pa.Array:
        return pa.concat_arrays([encode(part) for part in slices(chunk)] or [pa.array([], kinds)])

    return run


def compressed_chunks(df: DataFrame, cfg: CodecConfig = CodecConfig(), id_col: str = "id", content_col: str = "content", partitions: int | None = None) -> DataFrame:
    """(id, size, chunk_idx, orig_size, padding, lengths, data, literals, refs), one row per chunk.

    ``partitions`` spreads the chunks of few large values over so many tasks.
    """
    rows = split(df, cfg.chunk_size, id_col, content_col)
    rows = rows.repartition(partitions) if partitions else rows
    return rows.withColumn("z", chunk_encoder(cfg)("chunk")).select("id", "size", "chunk_idx", "z.*")


def _little(n: Column, width: int) -> Column:
    """A number as little-endian bytes, natively."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftrightunsigned(n, 8 * i).bitwiseAND(255)), 2, "0")) for i in range(width)])


def containers(chunks: DataFrame, chunk_size: int = CodecConfig.chunk_size) -> DataFrame:
    """(id, container), assembled natively from compressed chunks."""
    part = F.concat(_little(F.octet_length("data").cast("long"), 4), _little(F.col("orig_size"), 4), _little(F.col("padding").cast("long"), 1), F.col("lengths"), F.col("data"))
    rows = chunks.select("id", "size", F.struct("chunk_idx", part.alias("part")).alias("p"))
    whole = rows.groupBy("id").agg(F.first("size").alias("size"), F.sort_array(F.collect_list("p")).alias("p"))
    head = F.concat(F.lit(MAGIC), _little(F.col("size"), 8), _little(F.size("p").cast("long"), 4), F.lit(struct.pack("<I", chunk_size)))
    return whole.select("id", F.aggregate("p", head, lambda acc, x: F.concat(acc, x["part"])).alias("container"))


@F.arrow_udf(T.BinaryType())
def decompress_column(container: pa.Array) -> pa.Array:
    """Restores containers; a corrupt one fails the task with a clear error."""
    return pa.array([None if c is None else decompress(c) for c in container.to_pylist()], pa.binary())


@F.arrow_udf(T.BinaryType())
def compress_column(content: pa.Array) -> pa.Array:
    return pa.array([None if c is None else compress(c) for c in content.to_pylist()], pa.binary())


@F.arrow_udf(T.BinaryType())
def restore_column(chunk: pa.Array) -> pa.Array:
    """The bytes of parsed chunks; a corrupt one fails the task with a clear error."""
    return pa.array([None if c is None else decompress_chunk(Chunk(c["orig_size"], c["padding"], c["lengths"], c["data"])) for c in chunk.to_pylist()], pa.binary())


@F.arrow_udf(PARSED_TYPE)
def parse_column(container: pa.Array) -> pa.Array:
    out = []
    for c in container.to_pylist():
        out.append(None if c is None else [{"chunk_idx": i, "orig_size": x.orig_size, "padding": x.padding, "lengths": x.lengths, "data": x.data} for i, x in enumerate(parse(c)[2])])
    kinds = [("chunk_idx", pa.int32()), ("orig_size", pa.int64()), ("padding", pa.int32()), ("lengths", pa.binary()), ("data", pa.binary())]
    return pa.array(out, pa.list_(pa.struct(kinds)))


#: So many tokens at least are sent on in one batch; a chunk is never cut.
BATCH_TOKENS = 1 << 17


TOKEN_NAMES = ("chunk_idx", "pos", "flag", "byte_val", "offset", "length")


def token_reader():
    """Batches of (id, container) to batches of tokens, each of bounded size."""

    def batch(ids: pa.Array, held: list[tuple]) -> pa.RecordBatch:
        sizes = [len(x[2]) for x in held]
        own = ids.take(pa.array(np.repeat([x[0] for x in held], sizes)))
        chunk = np.repeat(np.array([x[1] for x in held], np.int32), sizes)
        pos = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        rest = [np.concatenate([x[k] for x in held]).astype(np.int32) for k in range(2, 6)]
        return pa.RecordBatch.from_arrays([own, *map(pa.array, (chunk, pos, *rest))], names=["id", *TOKEN_NAMES])

    def read(batches):
        for b in batches:
            held, size = [], 0
            for row, packed in enumerate(b.column(1)):
                if not packed.is_valid:
                    continue
                for i, c in enumerate(parse(packed.as_py())[2]):
                    tokens = lz77.token_arrays(chunk_stream(c))
                    held.append((row, i, *tokens))
                    size += len(tokens[0])
                    if size >= BATCH_TOKENS:
                        yield batch(b.column(0), held)
                        held, size = [], 0
            if held:
                yield batch(b.column(0), held)

    return read


def token_rows(containers: DataFrame) -> DataFrame:
    """(id, chunk_idx, pos, flag, byte_val, offset, length): the literals (flag 0) and references (flag 1) of containers (id, container) as rows, in order, read from their streams.

    Rows leave in batches of bounded size, so a task holds the tokens of one batch and one chunk only.
    """
    rows = containers.select("id", "container")
    return rows.mapInArrow(token_reader(), T.StructType([rows.schema["id"], *[T.StructField(n, T.IntegerType()) for n in TOKEN_NAMES]]))


def token_text(flag: Column, byte: Column, offset: Column, length: Column) -> Column:
    """A token for reading: Lit(byte) or Ref(offset=..., len=...)."""
    return F.when(flag == lz77.LITERAL, F.format_string("Lit(%d)", byte)).otherwise(F.format_string("Ref(offset=%d, len=%d)", offset, length))


STATISTICS = ("original_bytes", "compressed_bytes", "num_chunks", "ratio", "saving_pct", "lz77_literals", "lz77_refs")


def statistics(chunks: DataFrame) -> DataFrame:
    """One row per input: sizes, chunks, ratio and saving (null for empty input), literals and references."""
    size = F.first("size").alias("original_bytes")
    out = F.sum(F.octet_length("data") + CHUNK_HEAD.size).alias("parts")
    rows = chunks.groupBy("id").agg(size, out, F.count(F.lit(1)).alias("num_chunks"), F.sum("literals").alias("lz77_literals"), F.sum("refs").alias("lz77_refs"))
    total = F.col("parts") + HEAD.size
    share, saving = ratio(total, F.col("original_bytes")), saving_percent(total, F.col("original_bytes"))
    return rows.select("id", "original_bytes", total.alias("compressed_bytes"), "num_chunks", share.alias("ratio"), saving.alias("saving_pct"), "lz77_literals", "lz77_refs")


def byte_histogram(df: DataFrame, content_col: str = "content") -> DataFrame:
    """(byte, n) over a binary column."""
    pairs = F.regexp_extract_all(F.hex(content_col), F.lit("(..)"), F.lit(1))
    return df.select(F.explode(pairs).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).select(F.conv("h", 16, 10).cast("int").alias("byte"), "n")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def code_lengths_column(content: pa.Array) -> pa.Array:
    """The 256 prefix code lengths of the bytes of each value."""
    return pa.array([None if c is None else huffman.code_lengths(np.bincount(np.frombuffer(c, np.uint8), minlength=256).tolist()) for c in content.to_pylist()], pa.list_(pa.int32()))


def code_cost(df: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """(id, n_symbols, bits): the different bytes of each value and the bits of all its bytes under their prefix code."""
    n = F.size(F.filter("lengths", lambda x: x > 0)).cast("long")
    counts = df.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.hex(content_col), F.lit("(..)"), F.lit(1))).alias("h")).groupBy("id", "h").agg(F.count(F.lit(1)).alias("k"))
    lengths = df.where(F.octet_length(content_col) > 0).select(F.col(id_col).alias("id"), code_lengths_column(content_col).alias("lengths"))
    each = counts.join(lengths, "id").select("id", n.alias("n"), (F.col("k") * F.element_at("lengths", F.conv("h", 16, 10).cast("int") + 1)).alias("bits"))
    return each.groupBy("id").agg(F.max("n").alias("n_symbols"), F.sum("bits").alias("bits"))
