import datetime as dt

import pytest

from tokenloom.sources import corpus, strictcsv


@pytest.mark.parametrize(
    ("line", "fields"),
    [("a,b", ["a", "b"]), ('"a,b",c', ["a,b", "c"]), ('a"x,y"b,c', ["ax,yb", "c"]), ('"a""b"', ['a"b']), ("", [""]), ("a,", ["a", ""]), ('"open,x', ["open,x"]), ("x\r", ["x\r"]), ('""', [""]), ('"",a', ["", "a"])],
)
def test_lenient_line(line, fields):
    assert corpus.split_line(line) == fields


def test_corpora(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\n\ntwo\nthree")
    assert [r.text for r in corpus.corpus(spark, str(tmp_path / "a.txt")).orderBy("doc_id").collect()] == ["one\r", "two", "three"]
    assert [r.text for r in corpus.corpus(spark, str(tmp_path / "a.txt"), 2).orderBy("doc_id").collect()] == ["one\r", "two"]
    (tmp_path / "b.CSV").write_text('id,TEXT\n1,"x, y"\n2\n3,\n')
    assert [r.text for r in corpus.corpus(spark, str(tmp_path / "b.CSV")).orderBy("doc_id").collect()] == ["x, y", "2"]
    (tmp_path / "c.csv").write_text("first,second\nv,w\n")
    assert [r.text for r in corpus.corpus(spark, str(tmp_path / "c.csv")).collect()] == ["v"]


def test_several_files_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n1,alpha\n2,beta\n")
    (tmp_path / "b.csv").write_text("TEXT,id\ngamma,3\n\ndelta\n")
    (tmp_path / "c.csv").write_text("x,y\nepsilon,5\n")
    rows = corpus.csv_corpus(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["alpha", "beta", "gamma", "delta", "epsilon"] and len({r.doc_id for r in rows}) == 5
    assert [r.text for r in corpus.csv_corpus(spark, str(tmp_path), 3).orderBy("doc_id").collect()] == ["alpha", "beta", "gamma"]


def test_lines_of_a_file_in_several_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" for i in range(5000)))
    (tmp_path / "b.txt").write_text("x\ny\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = corpus.text_corpus(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 1 and [r.text for r in rows.orderBy("doc_id").collect()] == [*map(str, range(5000)), "x", "y"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_over_several_lines():
    lines = ["a,b", '1,"x', "", 'y ""z""",2', '3,"q"', 'open,"', "end"]
    records = list(strictcsv.assemble(lines))
    assert records == ["a,b", '1,"x\n\ny ""z""",2', '3,"q"', 'open,"\nend']
    assert strictcsv.split_record(records[1]) == ["1", 'x\n\ny "z"', "2"]
    assert strictcsv.split_record("a\rb,c") == ["a\rb", "c"] and strictcsv.split_record("") == [""]


def test_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"a\xffb\r\nc\rd")
    assert corpus.text_files(spark, str(tmp_path / "x.bin")).first().text == "a�b\nc\nd"
    out = tmp_path / "out"
    corpus.write_files(spark.createDataFrame([("n/y.bin", bytearray(b"\0\1"))], "name string, content binary"), str(out))
    assert (out / "n/y.bin").read_bytes() == b"\0\1"
    assert corpus.compressed_name("d/a.txt") == "d/a_compressed.clm" and corpus.restored_name("d/a_compressed.clm") == "d/a_decompressed.txt"


GOOD = '7,"a ""b"", c",1,,2024-02-29 23:59:59'
NAMES = ["essay_id", "text", "is_generated", "grade", "submitted_at"]


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        (GOOD, None),
        (GOOD + "\r", None),
        ('7,"a,1,2,2024-01-01 00:00:00', "quoting"),
        ('7,a "b" c,1,2,2024-01-01 00:00:00', "quoting"),
        ('7,"a" b,1,2,2024-01-01 00:00:00', "quoting"),
        ('7,a,b,1,2,2024-01-01 00:00:00"', "quoting"),
        ("7,a,b,1,2,2024-01-01 00:00:00", "column_count"),
        ("7", "column_count"),
        ("0,a,1,2,2024-01-01 00:00:00", "invalid_value"),
        ("1234567890123456,a,1,2,2024-01-01 00:00:00", "invalid_value"),
        ("7, \t,1,2,2024-01-01 00:00:00", "invalid_value"),
        ("7,a,2,2,2024-01-01 00:00:00", "invalid_value"),
        ("7,a,1,13,2024-01-01 00:00:00", "invalid_value"),
        ("7,a,1,1.0,2024-01-01 00:00:00", "invalid_value"),
        ("7,a,1,2,2023-02-29 00:00:00", "invalid_value"),
        ("7,a,1,2,2024-01-01", "invalid_value"),
        ("٣,a,1,2,2024-01-01 00:00:00", "invalid_value"),
    ],
)
def test_strict_record(line, reason):
    assert strictcsv.parse_record(line, NAMES)[0] == reason


def test_strict_lines(spark):
    rows = [
        (1, "a.csv", 1, '﻿"Text",essay_id,grade,is_generated,submitted_at\r', "x"),
        (2, "a.csv", 2, 'hello,5,12,0,2024-01-01 10:00:00\r', "x"),
        (2, "a.csv", 2, 'hello,5,12,0,2024-01-01 10:00:00\r', "x"),
        (3, "a.csv", 3, "  \r", "x"),
        (4, "a.csv", 4, None, "x"),
        (5, "a.csv", 5, '"' + "long " * 60_000 + '",6,,1,2024-01-01 10:00:00', "x"),
        (6, "b.csv", 2, "5,hello,0,12,2024-01-01 10:00:00", "x"),
        (7, None, 9, "5,hello", "x"),
        (None, "a.csv", 7, "x", "x"),
    ]
    lines = spark.createDataFrame(rows, "line_id long, file_name string, line_no int, line string, reason string")
    out = {r.line_id: r for r in strictcsv.parse_lines(lines).collect()}
    assert set(out) == {2, 5, 6, 7}
    assert (out[2].reason, out[2].essay_id, out[2].text, out[2].grade, out[2].submitted_at) == (None, 5, "hello", 12, dt.datetime(2024, 1, 1, 10))
    assert out[5].reason is None and len(out[5].text) == 300_000 and out[5].grade is None
    assert out[6].reason == out[7].reason == "column_count"
    assert strictcsv.rejected(lines.limit(0)).count() == 0 and strictcsv.valid(lines).count() == 2


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_blocks_of_any_size_give_each_line_once(tmp_path, monkeypatch, block):
    data = "﻿id,tExt\n\n1,ab\n2,\"x, y\"\n\n,\n3\nlast,líne\r".encode() + b"\xff"
    (tmp_path / "a.csv").write_bytes(data)
    path = f"file:{tmp_path}/a.csv"
    monkeypatch.setattr(corpus, "READ_BYTES", 4)
    cuts = [(i, min(i + block, len(data))) for i in range(0, len(data), block)]
    got = [x for c in cuts for x in corpus.block_lines(path, *c)]
    assert [x[1] for x in got] == data.split(b"\n") and all(data[at : at + len(x)] == x for at, x in got)
    assert [x[1] for c in cuts for x in corpus.block_texts(path, *c, True)] == [b"ab", b"x, y", b"3", "líne\r".encode() + b"\xff"]


def test_files_with_odd_names_empty_hidden_or_packed(spark, tmp_path):
    import gzip

    for name, text in {"a b%20#ü.txt": b"one\n", "b.txt": b"", "_c.txt": b"hidden\n", "d.txt.gz": gzip.compress(b"two\n\nthree"), "e.txt": b"\xef\xbb\xbfx\n\n"}.items():
        (tmp_path / name).write_bytes(text)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/x.txt").write_bytes(b"not of this folder\n")
    assert {r.path.rpartition("/")[2]: r.size for r in corpus.files(spark, str(tmp_path)).collect()}.keys() == {"a b%20#ü.txt", "b.txt", "d.txt.gz", "e.txt"}
    assert [(r.place, r.text) for r in corpus.placed_texts(spark, str(tmp_path)).orderBy("place").collect()] == [(1, "one"), (2, "two"), (3, "three"), (4, "﻿x")]
    assert [r.text for r in corpus.text_corpus(spark, str(tmp_path / "e*.txt")).collect()] == ["﻿x"]
    with pytest.raises(FileNotFoundError):
        corpus.files(spark, str(tmp_path / "none"))


def test_many_small_files_take_few_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"{i}.txt").write_text(f"{i}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        for rows in (corpus.files(spark, str(tmp_path)), corpus.lines(spark, str(tmp_path))):
            assert rows.count() == 200 and rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
