"""Problem 4: rows that fail to parse, set apart with the reason.

Records are assembled from lines quote-aware, parsed by Python's strict csv
reader inside ``mapInArrow``, and structural failures are caught before any
field is typed.  In the tables of this project a field never spans lines, so a
line is a record; ``assemble`` joins lines for files where quoted fields do.
The header of a file may name its columns in any order, so the lines are joined
with the headers of their files; that join is a plain equi-join which Spark
splits where one file holds most lines.
"""

from __future__ import annotations

import csv
import datetime as dt
import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("essay_id", "text", "is_generated", "grade", "submitted_at")
_FIELD = re.compile(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,|$)')
_TIME = re.compile(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", re.ASCII)
csv.field_size_limit(sys.maxsize)
_SCHEMA = "line_id long, file_name string, line_no int, reason string, essay_id long, text string, is_generated int, grade int, submitted_at timestamp_ntz"


class BrokenQuoting(ValueError):
    """The line cannot be split into fields."""


def assemble(lines: Iterable[str]) -> Iterator[str]:
    """Records of lines: a line with an odd number of quotes goes on in the next one, up to the line that closes it."""
    held: list[str] = []
    is_open = False
    for line in lines:
        held.append(line)
        is_open ^= line.count('"') % 2 == 1
        if not is_open:
            yield "\n".join(held)
            held = []
    if held:
        yield "\n".join(held)


#: What stands for line breaks while the reader, which takes them for ends of records, sees a field: private use characters.
_BREAKS = (("\r", "\U000f0d0d"), ("\n", "\U000f0a0a"))


def split_record(line: str) -> list[str]:
    """The fields of one record; quotes only around a whole field, doubled inside.

    The strict reader lets quotes pass inside a field that does not begin with
    one; those are caught first.
    """
    at, quoted = 0, '"' in line
    while quoted:
        m = _FIELD.match(line, at)
        if not m:
            raise BrokenQuoting(line)
        at = m.end()
        if at == len(line):
            break
    broken = "\r" in line or "\n" in line
    if broken:
        for char, sign in _BREAKS:
            line = line.replace(char, sign)
    try:
        (record,) = csv.reader([line], strict=True) if line else ([""],)
    except (csv.Error, ValueError) as e:
        raise BrokenQuoting(line) from e
    if broken:
        for char, sign in _BREAKS:
            record = [f.replace(sign, char) for f in record]
    return record


def _typed(values: dict[str, str]) -> tuple:
    """Typed fields of a record; ValueError for any that is out of its domain."""
    key, grade, when = values["essay_id"], values["grade"], values["submitted_at"]
    if not (key.isascii() and key.isdigit() and len(key) <= 15 and int(key) > 0):
        raise ValueError("essay_id")
    if not values["text"].strip():
        raise ValueError("text")
    if values["is_generated"] not in ("0", "1"):
        raise ValueError("is_generated")
    if grade and not (grade.isascii() and grade.isdigit() and 1 <= int(grade) <= 12):
        raise ValueError("grade")
    if not _TIME.fullmatch(when):
        raise ValueError("submitted_at")
    return int(key), values["text"], int(values["is_generated"]), int(grade) if grade else None, dt.datetime.strptime(when, "%Y-%m-%d %H:%M:%S")


def header_columns(line: str | None) -> list[str] | None:
    """Column names of a header line, or None if it is none."""
    try:
        names = [c.strip().lower() for c in split_record((line or "").removeprefix("﻿").rstrip("\r"))]
    except BrokenQuoting:
        return None
    return names if set(COLUMNS) <= set(names) else None


def parse_record(line: str, names: list[str] | None) -> tuple:
    """(reason, *typed fields): reason is None for a valid record."""
    none = (None,) * len(COLUMNS)
    try:
        fields = split_record(line.removesuffix("\r"))
    except BrokenQuoting:
        return ("quoting", *none)
    if names is None or len(fields) != len(names):
        return ("column_count", *none)
    try:
        return (None, *_typed(dict(zip(names, fields, strict=True))))
    except ValueError:
        return ("invalid_value", *none)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.timestamp("us")]
    names = ["line_id", "file_name", "line_no", "reason", *COLUMNS]
    headers: dict[str | None, list[str] | None] = {}
    for b in batches:
        rows = []
        for line, head in zip(b.column("line").to_pylist(), b.column("header").to_pylist(), strict=True):
            if head not in headers:
                if len(headers) > 10_000:
                    headers.clear()
                headers[head] = header_columns(head)
            rows.append(parse_record(line, headers[head]))
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
        data = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("line_id"), b.column("file_name"), b.column("line_no"), *data], names=names)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Every data line once: typed where valid, with ``reason`` (quoting, column_count, invalid_value) where not.

    ``lines`` holds (line_id, file_name, line_no, line); line 1 of a file is its
    header.  Headers, blank and null lines are no records; repeated rows of a
    key count once; lines of a file without a readable header, or without a
    file name, fail with ``column_count``; an empty table gives no rows.
    """
    whole = F.struct(F.col("line_no").cast("int").alias("line_no"), "file_name", "line")
    once = lines.where("line_id is not null").groupBy("line_id").agg(F.min(whole).alias("r")).select("line_id", "r.*")
    headers = lines.where("line_no = 1 and file_name is not null").groupBy("file_name").agg(F.min("line").alias("header"))
    data = once.where("coalesce(line_no, 0) <> 1").where(F.length(F.trim(F.regexp_replace("line", r"[\s ﻿]+", ""))) > 0)
    joined = data.join(headers, "file_name", "left").select("line_id", "file_name", "line_no", "line", "header")
    return joined.mapInArrow(_parse, _SCHEMA)


def rejected(lines: DataFrame) -> DataFrame:
    """(line_id, reason) of the lines that fail."""
    return parse_lines(lines).where("reason is not null").select("line_id", "reason")


def valid(lines: DataFrame) -> DataFrame:
    """The valid rows, typed."""
    return parse_lines(lines).where("reason is null").select("line_id", *COLUMNS)
