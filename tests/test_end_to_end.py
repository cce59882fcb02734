import pytest

from tokenloom import cli
from tokenloom.functions import register
from tokenloom.operators import bpe, charcodec, unigram
from tokenloom.plans.config import BpeConfig
from tokenloom.streaming.encode import bpe_stream


def test_files(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_bytes(b"Hello this is a line\n" * 50)
    (src / "b.txt").write_bytes(b"")
    (src / "c.bin").write_bytes(bytes(range(256)) * 5000)
    stats = {r.name: r for r in cli.compress_paths(spark, str(src), str(tmp_path / "z")).collect()}
    assert set(stats) == {f"{x}_compressed.clm" for x in "abc"}
    assert stats["a_compressed.clm"].ratio < 1 and stats["a_compressed.clm"].original == "1.03 KB" and stats["c_compressed.clm"].num_chunks == 3
    assert stats["b_compressed.clm"].ratio is None and stats["b_compressed.clm"].compressed_bytes == 289 == (tmp_path / "z/b_compressed.clm").stat().st_size
    assert cli.main(["decompress", str(tmp_path / "z"), str(tmp_path / "out")]) == 0
    for name in ("a.txt", "b.txt", "c.bin"):
        assert (tmp_path / f"out/{name[0]}_decompressed.txt").read_bytes() == (src / name).read_bytes()
    (src / "c.bin").unlink()
    assert cli.main(["compress-text", str(src), str(tmp_path / "t")]) == 0 and "a.txt" in capsys.readouterr().out
    assert charcodec.decompress((tmp_path / "t/a.txt.lzh").read_bytes()) == "Hello this is a line\n" * 50
    assert cli.self_test()


def test_sql_encoders(spark):
    docs = spark.createDataFrame([(0, "helloWorld the hello, it's $5"), (1, ""), (2, None), (3, "the World «x» h\0i")], "doc_id long, text string")
    vocab = bpe.train(docs)
    register.register_bpe(spark, vocab)
    model = unigram.train(docs)
    register.register_sp(spark, model)
    docs.createOrReplaceTempView("encoded_docs")
    got = {r.doc_id: (r.b, r.s) for r in spark.sql("select doc_id, bpe_encode(text) as b, sp_encode(text) as s from encoded_docs").collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, [r.subword for r in vocab.collect()], bpe.id_map(vocab), BpeConfig(preserve_unknown=False)).collect()}
    sp = {r.doc_id: r.ids for r in unigram.encode(docs, model).collect()}
    assert got == {i: (ids[i], sp[i]) for i in ids} and ids[0] and sp[0]


def test_modes():
    assert [cli.parse_mode(x) for x in ("", "BPE", "sp", "SentencePiece")] == ["bpe", "bpe", "sp", "sp"]
    with pytest.raises(ValueError, match="unknown"):
        cli.parse_mode("x")


@pytest.mark.parametrize("mode", ["bpe", "sp"])
def test_tokenize(spark, tmp_path, mode):
    (tmp_path / "c.txt").write_text("the cat sat\nthe hat sat\n")
    out = cli.tokenize(spark, mode, "The cat", str(tmp_path / "c.txt"), str(tmp_path / "m"))
    assert out["decoded"] == "the cat" and out["approx"] == 2 and out["vocab_size"] > 5
    if mode == "bpe":
        again = cli.tokenize(spark, mode, "The cat", "unused", str(tmp_path / "m"))
        assert again["pieces"] == out["pieces"] and again["ids"] == out["ids"]
    else:
        assert "".join(out["display"]) == "thecat"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "ab a"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    vocab = spark.createDataFrame([("ab",), ("a",), ("b",)], "subword string")
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = bpe_stream(stream, ["ab", "a", "b"], bpe.id_map(vocab)).writeStream.format("memory").queryName("encoded").start()
    q.processAllAvailable()
    q.stop()
    assert {r.doc_id: r.ids for r in spark.table("encoded").collect()} == {1: [1, 3], 2: None}


def test_registry(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "pretoken_by_lang" in queries and "p4_found" in queries
    assert entry.entry(spark).columns == ["lang", "n_tokens", "n_punct", "n_types"]
