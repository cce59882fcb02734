"""Problem 7: occurrences and records of every term, by external sort and run-length scan.

Pairs of term and record are range-partitioned and sorted by both, so a hot
term spans several partitions and no task holds it whole.  A scan over the
sorted rows adds up each run of equal terms and the distinct records in it; a
term has one partial row per partition it reaches into, and those few are
summed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut

RARE_BELOW = 10
COMMON_SHARE = 0.05


def counted_records(df: DataFrame, id_col: str = "ws_id", terms_col: str = "symbols", weight_col: str = "freq") -> DataFrame:
    """(id, terms, weight) of the records that count: weight above 0 and at least one term that is not null, once per key.

    Of differing rows of one key the one with the largest weight counts.
    """
    terms = F.filter(F.col(terms_col), lambda x: x.isNotNull())
    rows = df.select(F.col(id_col).alias("id"), F.col(weight_col).alias("weight"), terms.alias("terms"))
    rows = rows.where("id is not null and weight > 0 and size(terms) > 0")
    return rows.groupBy("id").agg(F.max(F.struct("weight", "terms")).alias("r")).select("id", "r.weight", "r.terms")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, occurrences, records) partial sums from rows (term, id, weight) sorted by term and id."""
    names = ["term", "occurrences", "records"]
    last: tuple[str, int] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        term, ids, weight = b.columns
        changed = pc.or_(pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)), pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)))
        first = (term[0].as_py(), ids[0].as_py()) != last
        fresh = pa.concat_arrays([pa.array([first]), changed])
        last = (term[-1].as_py(), ids[-1].as_py())
        t = pa.table({"term": term, "w": weight, "f": pc.cast(fresh, pa.int64())}).group_by("term", use_threads=False).aggregate([("w", "sum"), ("f", "sum")])
        yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks() for c in ("term", "w_sum", "f_sum")], names=names)


def term_counts(df: DataFrame, id_col: str = "ws_id", terms_col: str = "symbols", weight_col: str = "freq", rare_below: int = RARE_BELOW, common_share: float = COMMON_SHARE) -> DataFrame:
    """(term, occurrences, records, mark): a term occurs ``weight`` times for each place it has.

    ``mark`` is ``rare`` for fewer than ``rare_below`` occurrences, ``common``
    for more than ``common_share`` of the counted records, else null.  Terms are
    compared exactly; the empty string is a term, null is none; an empty table
    gives no terms.
    """
    records = cut(counted_records(df, id_col, terms_col, weight_col))  # read by the count, the sampling of ranges and the sort
    total = records.count()
    rows = records.select(F.explode("terms").alias("term"), "id", F.col("weight").cast("long").alias("weight"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "term", "id").sortWithinPartitions("term", "id")
    runs = ordered.mapInArrow(_scan, "term string, occurrences long, records long")
    sums = runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    mark = F.when(F.col("occurrences") < rare_below, "rare").when(F.col("records") > common_share * total, "common")
    return sums.withColumn("mark", mark)
