"""Problem 8: fill windows of fixed capacity with documents, by large-item matching.

Sizes are whole tokens, so a capacity C allows at most C different ones: the
plan is made from their histogram, whose size never grows with the data, and
the documents are then dealt to the planned windows by their rank within their
size.  Documents above C / 3 are matched greedily, at most two to a window;
smaller ones go, largest first, into the tightest gap that holds them.  Only a
document larger than the window is split: into full windows and a rest, which
is packed like any other item.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one size, and the split documents, are ranked in parts of about so many rows, at least 64, so that none is ranked by one task however hot.
ROWS_PER_PART = 500_000
LEAST_PARTS = 64
#: Planned slots are broadcast up to so many (some 50 MB); their number follows the capacities, not the documents.
BROADCAST_SLOTS = 1_000_000

Slot = tuple[int, int, int, int, int]


def token_size(text_col: str = "text", n_tokens_col: str = "n_tokens") -> Column:
    """Tokens of a document: as measured, else one per UTF-8 byte and one end token."""
    return F.coalesce(F.col(n_tokens_col).cast("long"), F.octet_length(text_col).cast("long") + 1)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Slot], int]:
    """Slots (size, first rank, number of items, first window, items per window) and the number of windows.

    The items of a slot fill consecutive windows.  The work depends on the
    number of different sizes only.
    """
    slots: list[Slot] = []
    ranks: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first window, number of windows)
    keys: list[int] = []
    windows = 0

    def add_gap(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if not gaps[gap]:
                bisect.insort(keys, gap)
            gaps[gap].append((first, n))

    def put(size: int, items: int, first: int, per: int) -> None:
        slots.append((size, ranks[size], items, first, per))
        ranks[size] += items

    left = {s: n for s, n in histogram.items() if n > 0}
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        n = left[size]
        at = bisect.bisect_right(large, capacity - size) - 1
        if at < 0:
            put(size, n, windows, 1)
            add_gap(capacity - size, windows, n)
            windows += n
            large.pop()
            continue
        mate = large[at]
        if mate == size:
            pairs = n // 2
            if pairs:
                put(size, 2 * pairs, windows, 2)
                add_gap(capacity - 2 * size, windows, pairs)
            if n % 2:
                left[size] = 1
                others = [s for s in large[:-1] if s <= capacity - size]
                put(size, 1, windows + pairs, 1)
                free = capacity - size
                if others:
                    mate = others[-1]
                    put(mate, 1, windows + pairs, 1)
                    left[mate] -= 1
                    free -= mate
                    if not left[mate]:
                        large.remove(mate)
                add_gap(free, windows + pairs, 1)
            windows += pairs + n % 2
            large.pop()
            continue
        both = min(n, left[mate])
        put(size, both, windows, 1)
        put(mate, both, windows, 1)
        add_gap(capacity - size - mate, windows, both)
        windows += both
        for s in (size, mate):
            left[s] -= both
            if not left[s]:
                large.remove(s)
    for size in sorted((s for s in left if 3 * s <= capacity and s > 0), reverse=True):
        n = left[size]
        while n:
            at = bisect.bisect_left(keys, size)
            if at == len(keys):
                per = capacity // size
                full, rest = divmod(n, per)
                if full:
                    put(size, full * per, windows, per)
                    add_gap(capacity - per * size, windows, full)
                if rest:
                    put(size, rest, windows + full, rest)
                    add_gap(capacity - rest * size, windows + full, 1)
                windows += full + (rest > 0)
                break
            gap = keys[at]
            first, runs = gaps[gap].pop()
            if not gaps[gap]:
                keys.pop(at)
            per = gap // size
            full = min(runs, n // per)
            if full:
                put(size, full * per, first, per)
                add_gap(gap - per * size, first, full)
                n -= full * per
            rest_runs = runs - full
            if rest_runs:
                if n and n < per:
                    put(size, n, first + full, n)
                    add_gap(gap - n * size, first + full, 1)
                    n, full, rest_runs = 0, full + 1, rest_runs - 1
                add_gap(gap, first + full, rest_runs)
    return slots, windows


def parts_for(rows: int) -> int:
    return max(LEAST_PARTS, -(-rows // ROWS_PER_PART))


def _with_rank(items: DataFrame, key: list[str], order: list[str], n_parts: int) -> DataFrame:
    """0-based rank within the key in a fixed order, worked out in parts of each key."""
    parts = items.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)))
    counts = parts.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("in_part"))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*key, "part").orderBy(*order)
    ranked = parts.withColumn("within", F.row_number().over(within) - 1)
    return ranked.join(offsets, [*key, "part"]).withColumn("rank", F.col("within") + F.col("offset")).drop("part", "within", "offset")


def packed(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(window_key, window_id, doc_id, piece, tokens): the assignment of every document to windows of every capacity.

    ``windows`` holds (window_key, capacity); it is a fixed handful and read by
    the driver.  Documents with a null key or without any size take no part,
    empty ones count one token, rows that repeat a key count once (the smallest
    size), and windows without a positive capacity hold nothing.
    """
    kinds = [(w[0], int(w[1])) for w in windows.select("window_key", "capacity").distinct().where("capacity > 0 and window_key is not null").orderBy("window_key").collect()]
    spark = docs.sparkSession
    schema = "window_key string, size long, from_rank long, n_items long, first_window long, per long"
    if not kinds:
        return spark.createDataFrame([], "window_key string, window_id long, doc_id long, piece int, tokens long")
    sizes = docs.select(F.col(id_col).alias("doc_id"), token_size().alias("tokens")).where("doc_id is not null and tokens > 0").groupBy("doc_id").agg(F.min("tokens").alias("tokens"))
    each = F.array(*[F.struct(F.lit(k).alias("window_key"), F.lit(c).cast("long").alias("capacity")) for k, c in kinds])
    rows = sizes.select("doc_id", "tokens", F.explode(each).alias("w")).select("w.*", "doc_id", "tokens")
    rows = rows.withColumn("full", F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("long"))
    rows = rows.withColumn("size", F.col("tokens") - F.col("full") * F.col("capacity"))

    # One row per window and size: at most the sum of the capacities, however many documents there are.
    counted = rows.groupBy("window_key", "size").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("full") > 0).alias("split")).collect()
    slots: list[tuple] = []
    opened: dict[str, int] = {}
    for key, capacity in kinds:
        made, n = plan({r.size: r.n for r in counted if r.window_key == key}, capacity)
        slots += [(key, *s) for s in made]
        opened[key] = n
    table = spark.createDataFrame(slots, schema)
    if len(slots) <= BROADCAST_SLOTS:
        table = F.broadcast(table)
    ranked = _with_rank(rows, ["window_key", "size"], ["doc_id"], parts_for(max((r.n for r in counted), default=0)))
    hit = (ranked.window_key == table.window_key) & (ranked["size"] == table["size"]) & (ranked["rank"] >= table.from_rank) & (ranked["rank"] < table.from_rank + table.n_items)
    window_id = table.first_window + F.floor((ranked["rank"] - table.from_rank) / table.per)
    last = ranked.join(table, hit).select(ranked.window_key, window_id.cast("long").alias("window_id"), "doc_id", F.col("full").cast("int").alias("piece"), ranked["size"].alias("tokens"))

    # The full pieces of split documents have windows of their own, numbered after the planned ones.
    split = rows.where("full > 0")
    by_key: dict[str, int] = defaultdict(int)
    for r in counted:
        by_key[r.window_key] += r.split
    part = split.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts_for(max(by_key.values(), default=0)))))
    of_part = part.groupBy("window_key", "part").agg(F.sum("full").alias("n"))
    before = Window.partitionBy("window_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = of_part.select("window_key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("window_key", "part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("full").over(inside), F.lit(0)) + F.col("base")
    planned = F.coalesce(*[F.when(F.col("window_key") == k, F.lit(n)) for k, n in opened.items()])
    own = part.join(base, ["window_key", "part"]).withColumn("start", start + planned)
    own = own.select("window_key", "doc_id", "capacity", "start", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece"))
    full = own.select("window_key", (F.col("start") + F.col("piece")).alias("window_id"), "doc_id", "piece", F.col("capacity").alias("tokens"))
    return last.unionByName(full)


def split_documents(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(window_key, doc_id): the documents the packing had to split."""
    return packed(docs, windows, id_col).where("piece > 0").select("window_key", "doc_id").distinct()
