import hashlib
import random
from fractions import Fraction
from pathlib import Path

import __spark_entry__ as entry


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_sizes_beyond_64_bits(spark, tmp_path):
    ids = [3, 40_000_001, 20_088_923, 10**13 + 7, 2**20 * 5]
    d = written(spark, tmp_path, "documents", [(i, "xé" * 3333) for i in ids], "doc_id long, text string")
    got = {r.doc_id: r for r in entry.queries()["long_sizes_shown"](spark, d).collect()}
    for i in ids[1:]:
        b = Fraction(9999 * i * i)
        unit, name = (1024**5, "PB") if b >= 1024**5 else (1024**4, "TB")
        tenths = round(b / unit * 10)  # exact ties to the even digit
        assert got[i].size == f"{tenths // 10}.{tenths % 10} {name}" and got[i].took == "100.00 s"
        assert got[i].mb_per_s == round(float(9999 * i * i) / 1048576.0 / 100.0 * 1e9) / 1e9
    assert got[3].size == "87.9 KB"


def test_places_where_texts_and_numbers_differ_in_size(spark, tmp_path):
    """The texts fill several partitions when they are written, the numbers alone would fit one."""
    rng = random.Random(1)
    lines = [(f"f{k}.csv", 1, "id,Text") for k in range(6)] + [(f"f{k}.csv", i, f'{i},"{k}-{i} {rng.randbytes(1000).hex()}"') for k in range(6) for i in range(2, 60)]
    d = written(spark, tmp_path, "essay_csv_lines", [(n, *x) for n, x in enumerate(lines)], "line_id long, file_name string, line_no int, line string")
    docs = [(k, "\n".join(f"{k}/{i}" + rng.randbytes(500).hex() for i in range(k % 5))) for k in range(1, 150)]
    written(spark, tmp_path, "documents", docs, "doc_id long, text string")
    wanted = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8k"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        got = entry.queries()["csv_corpus_files"](spark, d).collect()
        assert {r.place: r.text.split()[0] for r in got} == {n: x for n, x in enumerate((f"{k}-{i}" for k in range(6) for i in range(2, 60)), 1)} and len(got) == 6 * 58
        got = entry.queries()["text_corpus_files"](spark, d).collect()
        want = [line for _, text in docs for line in text.split("\n") if line]
        assert {r.place: r.text for r in got} == dict(enumerate(want, 1)) and len(got) == len(want)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_lines_of_files_without_texts_and_with_any_numbers(spark, tmp_path):
    """No text at all is an empty corpus, no error; numbers of any sign and length keep their order."""
    d = written(spark, tmp_path / "none", "documents", [(1, None), (2, None)], "doc_id long, text string")
    assert entry.queries()["text_corpus_files"](spark, d).collect() == []
    ids = [-(2**63), -12, -3, 0, 7, 10**12 - 1, 9 * 10**12, 10**13, 2**63 - 1]
    d = written(spark, tmp_path / "some", "documents", [(i, f"{i}\n\nend {i}") for i in reversed(ids)], "doc_id long, text string")
    got = sorted((r.place, r.text) for r in entry.queries()["text_corpus_files"](spark, d).collect())
    assert got == list(enumerate((x for i in ids for x in (f"{i}", f"end {i}")), 1))


def test_laws_of_compression_hold_nothing_in_memory(spark, tmp_path):
    """Chunks are compressed once and read from files, which are removed; containers are put together once."""
    texts = [(1, "the same words again " * 300), (2, ""), (3, None), (4, "a"), (5, "".join(map(chr, range(32, 1200))) * 900)]
    d = written(spark, tmp_path, "documents", texts, "doc_id long, text string")
    before, kept = set(Path(spark.conf.get("spark.checkpoint.dir")).glob("files-*/*")), spark._jsc.getPersistentRDDs().size()
    laws = entry.queries()["compression_laws"](spark, d)
    assert "InMemoryTableScan" not in laws._jdf.queryExecution().toString()
    got = {r.id: tuple(r)[1:] for r in laws.collect()}
    sizes = {i: len(t.encode()) for i, t in texts if t is not None}
    assert got == {i: (n, max(1, -(-n // (512 * 1024))), n, True, True, n > 2000) for i, n in sizes.items()} and sizes[5] > 3 * 512 * 1024
    assert spark._jsc.getPersistentRDDs().size() == kept
    assert {p.name for p in set(Path(spark.conf.get("spark.checkpoint.dir")).glob("files-*/*")) - before} == {"laws"}


def test_files_in_between_are_removed(spark, tmp_path):
    d = written(spark, tmp_path, "documents", [(i, "text " * i) for i in range(9)] + [(9, None)], "doc_id long, text string")
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(Path(folder).glob("files-*/*"))
    got = entry.queries()["file_codec_roundtrip"](spark, d).collect()
    assert {r.name: r.h for r in got} == {f"{i}_decompressed.txt": hashlib.sha256(b"text " * i).hexdigest() for i in range(9)}
    assert {p.name for p in set(Path(folder).glob("files-*/*")) - before if p.is_dir()} == {"out"}
