"""Corpus scans: text lines, line-oriented CSV, whole files; and their sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from itertools import islice
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_csv_path(path: str) -> bool:
    return path.lower().endswith(".csv")


def split_line(line: str) -> list[str]:
    """Fields of one CSV line: a quote anywhere opens or closes quoting, doubled inside quotes it stands for itself.

    Quoted fields never span lines; a carriage return stays.
    """
    if '"' not in line:
        return line.split(",")
    fields: list[str] = []
    held = ""
    # Pieces between quotes are outside and inside by turns; an empty outside piece between two inside ones is a doubled quote.
    pieces = line.split('"')
    for i, piece in enumerate(pieces):
        if i % 2:
            held += piece
            continue
        if not piece and 0 < i < len(pieces) - 1:
            held += '"'
            continue
        first, *rest = piece.split(",")
        held += first
        for f in rest:
            fields.append(held)
            held = f
    return [*fields, held]


@F.arrow_udf(T.ArrayType(T.StringType()))
def split_line_column(line: pa.Array) -> pa.Array:
    return pa.array([None if x is None else split_line(x) for x in line.to_pylist()], pa.list_(pa.string()))


#: A file has fewer bytes than this; document ids are places of bytes, counted from a multiple of it on for each file.
FILE_SPAN = 1 << 42
#: Files are read in blocks of so many bytes, and in tasks of about so many bytes or files.
BLOCK_BYTES, TASK_FILES = 16 << 20, 5_000
#: So many bytes are read at once, or sent on in one batch.
READ_BYTES = 1 << 20
PACKED = (".gz", ".bz2", ".zst")
UNREADABLE = (".deflate", ".lz4", ".snappy")
_LISTED = "path string, size long"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a path as Hadoop writes it, and the place in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe="/:@"))


def _hidden(name: str) -> bool:
    """Names that Spark's scans pass over."""
    return name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")


def _entries(path: str) -> Iterator[tuple[str, int]]:
    """(path, size) of a file, or of the files in a folder and in its partitions."""
    where, root = _opened(path)
    if (own := where.get_file_info(root)).type == fs.FileType.File:
        yield path, own.size
        return
    for x in where.get_file_info(fs.FileSelector(root)):
        if not _hidden(x.base_name):
            if x.type == fs.FileType.File:
                yield f"{path.rstrip('/')}/{x.base_name}", x.size
            elif "=" in x.base_name:
                yield from _entries(f"{path.rstrip('/')}/{x.base_name}")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of the files of a path (a file, a folder or a pattern); they are listed on the executors, so the driver holds no names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    roots = [(x.getPath().toString(),) for x in where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []]
    if not roots:
        raise FileNotFoundError(path)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for root in b.column(0).to_pylist():
                found = _entries(root)
                while some := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.string()), pa.array([x[1] for x in some], pa.int64())], names=["path", "size"])

    return spark.createDataFrame(roots, "path string").mapInArrow(walk, _LISTED)


def _tasks(files: DataFrame) -> int:
    """As many tasks as there are cores, more for many bytes or files."""
    r = files.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).first()
    return max(files.sparkSession.sparkContext.defaultParallelism, -(-(r.size or 0) // BLOCK_BYTES), -(-r.n // TASK_FILES))


def _blocks(files: DataFrame) -> DataFrame:
    """(path, rank, start, end): blocks of files, ranked in order of the paths; only the names meet in one task, sorted on disk if need be."""
    ranked = files.repartition(1).sortWithinPartitions("path").select("path", "size", F.monotonically_increasing_id().alias("rank"))
    name = F.lower("path")
    whole = F.lit(False)
    for x in (*PACKED, *UNREADABLE):
        whole |= name.endswith(x)
    step = F.when(whole, F.greatest("size", F.lit(1))).otherwise(F.lit(BLOCK_BYTES)).cast("long")
    cut = ranked.where("size > 0").select("path", "rank", "size", step.alias("step"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step)).alias("start"))
    return cut.select("path", "rank", "start", F.least(F.col("start") + F.col("step"), "size").alias("end"))


def block_lines(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in a block of a file, without their line feeds."""
    if path.lower().endswith(UNREADABLE):
        raise ValueError(f"no reader for the compression of {path}")
    files, place = _opened(path)
    packed = path.lower().endswith(PACKED)
    with files.open_input_stream(place) if packed else files.open_input_file(place) as f:
        skip = bool(start)  # the line that reaches into the block belongs to the one before
        at = max(start - 1, 0)
        if skip:
            f.seek(at)
        held: list[bytes] = []
        while data := f.read(READ_BYTES):
            pieces = data.split(b"\n")
            for i, piece in enumerate(pieces):
                held.append(piece)
                if i == len(pieces) - 1:
                    break
                line = held[0] if len(held) == 1 else b"".join(held)
                held = []
                if not skip:
                    yield at, line
                skip = False
                at += len(line) + 1
                if at >= end and not packed:
                    return
        line = b"".join(held)
        if line and not skip:
            yield at, line


def first_line(path: str) -> str:
    for _, line in block_lines(path, 0, 1):
        return line.decode("utf-8", "surrogateescape")
    return ""


def block_texts(path: str, start: int, end: int, csv: bool) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the texts of a block: lines that are not empty, or the ``text`` column of line CSV by the file's own header."""
    if not csv:
        yield from (x for x in block_lines(path, start, end) if x[1])
        return
    column = header_column(first_line(path))
    for at, line in block_lines(path, start, end):
        if at and line:
            fields = split_line(line.decode("utf-8", "surrogateescape"))
            text = fields[column] if len(fields) > column else fields[0]
            if text:
                yield at, text.encode("utf-8", "surrogateescape")


def _texts(values: list[bytes]) -> pa.Array:
    """Strings of bytes as they are, which need not be valid UTF-8."""
    return pa.array(values, pa.binary()).view(pa.string())


def _batches(rows: Iterator[tuple], kinds: dict) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size; the last value of each row is its bytes."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([_texts(c) if k == pa.string() else pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    for r in rows:
        held.append(r)
        size += len(r[-1]) + 64
        if size >= 4 * READ_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, first, line) of text files, ``line_no`` rising in file order over all files, ``first`` marking the first line of a file.

    Only a line feed ends a line, a carriage return stays.  Files are in order
    of their paths; a line is numbered by the place of its first byte, so no
    pass over all lines is needed to number them (numbers rise but have gaps).
    """
    files = listing(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b["path"].encode(), b["rank"] * FILE_SPAN + at, at == 0, line) for b in _each_block(batches) for at, line in block_lines(b["path"], b["start"], b["end"]))
        yield from _batches(rows, {"file": pa.string(), "line_no": pa.int64(), "first": pa.bool_(), "line": pa.string()})

    return _blocks(files).repartition(_tasks(files)).mapInArrow(read, "file string, line_no long, first boolean, line string")


def _read_texts(spark: SparkSession, path: str, csv: bool) -> DataFrame:
    files = listing(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b["rank"] * FILE_SPAN + at, text) for b in _each_block(batches) for at, text in block_texts(b["path"], b["start"], b["end"], csv))
        yield from _batches(rows, {"doc_id": pa.int64(), "text": pa.string()})

    return _blocks(files).repartition(_tasks(files)).mapInArrow(read, "doc_id long, text string")


def placed_texts(spark: SparkSession, path: str, csv: bool = False) -> DataFrame:
    """(place, text): the texts of a corpus numbered from 1 on without gaps, in file order.

    The files are read twice: the texts of each block are counted first, and
    only those counts are ordered and summed up, so no text is shuffled or kept.
    """
    files = listing(spark, path)
    tasks = _tasks(files)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [sum(1 for _ in block_texts(x["path"], x["start"], x["end"], csv)) for x in b.to_pylist()]
            yield b.append_column("n", pa.array(n, pa.int64()))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            before = []
            for n in b.column("n").to_pylist():
                before.append(total)
                total += n
            yield b.append_column("before", pa.array(before, pa.int64()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b["before"] + i, text) for b in _each_block(batches) for i, (_, text) in enumerate(block_texts(b["path"], b["start"], b["end"], csv), 1))
        yield from _batches(rows, {"place": pa.int64(), "text": pa.string()})

    kinds = "path string, rank long, start long, end long, n long"
    counted = _blocks(files).repartition(tasks).mapInArrow(count, kinds)
    summed = counted.repartition(1).sortWithinPartitions("rank", "start").mapInArrow(add_up, f"{kinds}, before long")
    return summed.where("n > 0").repartition(tasks).mapInArrow(read, "place long, text string")


def text_corpus(spark: SparkSession, path: str, max_rows: int = 0) -> DataFrame:
    """(doc_id, text): the lines that are not empty, in file order."""
    return cap(_read_texts(spark, path, csv=False), max_rows)


def header_column(line: str) -> int:
    """The place of the column called ``text`` (in any ASCII case) in a header line, else 0."""
    names = [n.lower() if n.isascii() else n for n in split_line(line)]
    return names.index("text") if "text" in names else 0


@F.arrow_udf(T.IntegerType())
def text_column(header: pa.Array) -> pa.Array:
    """The place of the column called ``text`` in each header line, else 0."""
    return pa.array([header_column(x or "") for x in header.to_pylist()], pa.int32())


def csv_corpus(spark: SparkSession, path: str, max_rows: int = 0) -> DataFrame:
    """(doc_id, text): the ``text`` column of each file's own header (in any ASCII case), else its first column.

    A row too short for the column falls back to its first field; empty text is dropped.
    """
    return cap(_read_texts(spark, path, csv=True), max_rows)


def cap(corpus: DataFrame, max_rows: int) -> DataFrame:
    """The first rows in file order; 0 keeps all."""
    return corpus.orderBy("doc_id").limit(max_rows) if max_rows else corpus


def corpus(spark: SparkSession, path: str, max_rows: int = 0) -> DataFrame:
    """A corpus by its extension."""
    return (csv_corpus if is_csv_path(path) else text_corpus)(spark, path, max_rows)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, content) of whole files, empty ones too."""
    found = listing(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[bytes, int, bytes]]:
            for b in batches:
                for name in b.column(0).to_pylist():
                    where, place = _opened(name)
                    with where.open_input_file(place) as f:
                        content = f.read()
                    yield name.encode(), len(content), content

        yield from _batches(rows(), {"path": pa.string(), "size": pa.int64(), "content": pa.binary()})

    return found.repartition(_tasks(found)).mapInArrow(read, "path string, size long, content binary")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): invalid UTF-8 replaced, all line ends as line feeds."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files(spark, path).select("path", F.regexp_replace(text, "\r\n?", "\n").alias("text"))


def _rooted(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else Path(folder).resolve().as_uri())


def scratch(spark: SparkSession) -> str:
    """A new folder for files in between, in the folder all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{named or tempfile.gettempdir()}/files-{uuid.uuid4().hex}"


def remove(folder: str) -> None:
    """Delete a folder of files in between; one that was never written is no error."""
    where, root = _rooted(folder)
    if where.get_file_info(root).type == fs.FileType.Directory:
        where.delete_dir(root)


def write_files(df: DataFrame, folder: str) -> None:
    """Write each (name, content) to a file of its own in a folder all executors reach, on any file system Arrow knows by its URI."""
    where = folder if "://" in folder else Path(folder).resolve().as_uri()
    made, top = _rooted(folder)
    made.create_dir(top, recursive=True)  # no rows leave an empty folder, which can be scanned

    def put(rows) -> None:
        files, root = fs.FileSystem.from_uri(where)
        made = set()
        for r in rows:
            target = f"{root}/{r.name}"
            if (parent := target.rpartition("/")[0]) not in made:
                files.create_dir(parent, recursive=True)
                made.add(parent)
            with files.open_output_stream(target) as out:
                out.write(bytes(r.content))

    df.select("name", "content").foreachPartition(put)


def compressed_name(path: str) -> str:
    return str(Path(path).with_suffix("")) + "_compressed.clm"


def restored_name(path: str) -> str:
    return str(Path(path).with_suffix("")).removesuffix("_compressed") + "_decompressed.txt"
