"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of few files as many partitions as there are cores; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a folder of its own; a cluster,
    whose machines share no such folder, is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{tempfile.gettempdir()}/tokenloom-shared"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows as a table in the shared folder and read them back.

    The table survives the loss of executors.  It is removed by ``release``,
    or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Ids are filtered by a broadcast of 16 bits for each up to so many (64 MB in all); more of them are joined instead.
FILTER_IDS = 32_000_000
_CHUNK = 1 << 13


def _bits(ids: np.ndarray, chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """The chunk of each id and its four bits in it."""
    from .kernel import mix64

    h = mix64(ids.astype(np.int64).view(np.uint64))
    at = mix64(h)
    return (h % np.uint64(chunks)).astype(np.int64), np.stack([(at >> np.uint64(16 * k)) & np.uint64(8 * _CHUNK - 1) for k in range(4)]).astype(np.int64)


def id_filter(ids: DataFrame, count: int) -> bytes:
    """A blocked Bloom filter over the first column of ``ids``, as long as their number asks for; each chunk is built by one task, and each id sent once."""
    chunks = max(1, -(-count * 2 // _CHUNK))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunk, _ = _bits(b.column(0).to_numpy(), chunks)
            yield pa.RecordBatch.from_arrays([pa.array(chunk), b.column(0)], names=["chunk", "id"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            chunk, at = _bits(b.column(1).to_numpy(), chunks)
            order = np.argsort(chunk, kind="stable")
            used, first = np.unique(chunk[order], return_index=True)
            for k, some in zip(used.tolist(), np.split(order, first[1:]), strict=True):
                own = held.setdefault(k, np.zeros(8 * _CHUNK, bool))
                own[at[:, some].ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], names=["chunk", "bits"])

    out = bytearray(chunks * _CHUNK)
    for k, x in ids.mapInArrow(place, "chunk long, id long").repartition("chunk").mapInArrow(build, "chunk long, bits binary").collect():
        out[k * _CHUNK : (k + 1) * _CHUNK] = x
    return bytes(out)


def may_hold(bits: bytes, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the filter; those in it always are."""
    held = np.frombuffer(bits, np.uint8)
    chunk, at = _bits(ids, len(held) // _CHUNK)
    return (held[chunk * _CHUNK + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8) & 1).all(0)


def only_ids(rows: DataFrame, ids: DataFrame, most: int = FILTER_IDS) -> DataFrame:
    """The rows whose ``id`` is among ``ids`` (column id, distinct).

    Up to ``most`` ids a broadcast filter spares the shuffle of the rows, at
    the price of letting about one other row in 400 pass; more ids are joined.
    """
    n = ids.count()
    if n > most:
        return rows.join(ids, "id", "left_semi")
    wanted = rows.sparkSession.sparkContext.broadcast(id_filter(ids, n))
    at = rows.columns.index("id")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(may_hold(wanted.value, b.column(at).to_numpy())))

    return rows.mapInArrow(keep, rows.schema)


HOT_LEAST = 10_000
SALTS = 64


def hot_from(spark: SparkSession, rows: int, least: int = HOT_LEAST) -> int:
    """A key with more rows than this is hot: a quarter of a mean partition, so there are at most four hot keys for each (or 2,000)."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, rows // max(2000, 4 * parts))


def expand(pairs: DataFrame, members: DataFrame, key: list[str], hot_least: int = HOT_LEAST) -> DataFrame:
    """``pairs`` with the columns of ``members`` that have the same ``key``, one row for each member.

    Hot classes are found exactly by partial counts; their members are dealt
    over salts and their pairs sent to each of them, all others take a plain
    join.  ``members`` is read several times and should be a written table.
    """
    sizes = members.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.where(F.col("n") > hot_from(members.sparkSession, members.count(), hot_least)).select(*key)
    names = hot.collect()  # few by definition
    if not names:
        return pairs.join(members, key)
    hot = F.broadcast(members.sparkSession.createDataFrame(names, hot.schema))
    rest = [c for c in members.columns if c not in key]
    salt = F.pmod(F.xxhash64(*rest), F.lit(SALTS)).cast("int") if rest else F.lit(0)
    salted = members.join(hot, key, "left_semi").withColumn("salt", salt)
    each = pairs.join(hot, key, "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    warm = each.join(salted, [*key, "salt"]).drop("salt")
    cold = pairs.join(hot, key, "left_anti").join(members.join(hot, key, "left_anti"), key)
    return warm.unionByName(cold)


def release() -> None:
    """Remove the tables written so far; for sessions that run many queries, once the results are read."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may be gone
            continue


@atexit.register
def _remove() -> None:
    release()
