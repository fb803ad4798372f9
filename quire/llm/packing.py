"""Problem 7: documents into containers of a fixed number of tokens.

Hierarchical residual packing. Every partition packs its own items best fit,
the largest first; bins that are full enough are done. The others go on as
items of their own to the next round, where a few partitions' worth of them
meet in one and are packed again, until one partition is left, or more of them
are left than one task should hold and a round brings them together no
further. What goes where depends on the documents' keys and sizes alone, not
on how the input lies.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.llm.bpe import DEFAULT_TOKENIZER
from quire.llm.tokens import token_counts
from quire.session import materialize

#: A bin of at least this fill is done after the round that made it.
FULL = 0.995
#: So many partitions of a round meet in one of the next.
FAN_IN = 8
#: Bins of no more items than this, so that items of no tokens cannot pile up in one.
ITEMS_PER_BIN = 4_096
#: Items that meet in one task of a round, on average.
ITEMS_PER_TASK = 4_000


def best_fit(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """The bin of each item: decreasing sizes, each into the fullest bin that still holds it.

    ``counts`` are the documents an item stands for. Ties go to the earlier
    item and the earlier bin, so the result depends on the input alone.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    room: list[tuple[int, int]] = []  # (free tokens, bin), sorted
    held: list[int] = []
    where = [0] * len(sizes)
    for i in order:
        k = bisect_left(room, (sizes[i], -1))
        while k < len(room) and held[room[k][1]] + counts[i] > ITEMS_PER_BIN:
            k += 1
        if k < len(room):
            free, b = room.pop(k)
        else:
            free, b = capacity, len(held)
            held.append(0)
        where[i] = b
        held[b] += counts[i]
        if held[b] < ITEMS_PER_BIN:
            insort(room, (free - sizes[i], b))
    return where


def _round(df: DataFrame, capacity: int, number: int, last: bool) -> DataFrame:
    """(item, size, docs) to (item, start, place, bin, fill, docs, done); start and place are the tokens and documents before the item in its bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        items: list[str] = []
        sizes: list[int] = []
        docs: list[int] = []
        for b in batches:
            items += b.column(0).to_pylist()
            sizes += b.column(1).to_pylist()
            docs += b.column(2).to_pylist()
        if not items:
            return
        by_name = sorted(range(len(items)), key=items.__getitem__)
        items, sizes, docs = ([x[i] for i in by_name] for x in (items, sizes, docs))
        where = best_fit(sizes, docs, capacity)
        n = max(where) + 1
        fill, held, start, place = [0] * n, [0] * n, [], []
        for i, b in enumerate(where):
            start.append(fill[b])
            place.append(held[b])
            fill[b] += sizes[i]
            held[b] += docs[i]
        done = [last or f >= FULL * capacity for f in fill]
        part = TaskContext.get().partitionId()
        names = [f"{number:02d}-{part:06d}-{b:06d}" for b in range(n)]
        for k in range(0, len(items), 20_000):
            w = where[k : k + 20_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(items[k : k + 20_000]),
                    pa.array(start[k : k + 20_000], pa.int64()),
                    pa.array(place[k : k + 20_000], pa.int64()),
                    pa.array([names[b] for b in w]),
                    pa.array([fill[b] for b in w], pa.int64()),
                    pa.array([held[b] for b in w], pa.int64()),
                    pa.array([done[b] for b in w]),
                ],
                names=["item", "start", "place", "bin", "fill", "docs", "done"],
            )

    return df.select("item", "size", "docs").mapInArrow(run, "item string, start bigint, place bigint, bin string, fill bigint, docs bigint, done boolean")


def pieces(counts: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, piece, first_token, size, item): one row a document, more only where it has more tokens than a container.

    Such a document gives full pieces and a rest; a row with null or zero
    tokens gives one piece of size 0. Rows with the same key and size are
    told apart by a number, which any of them may have.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / F.lit(float(capacity))).cast("int") - 1)
    alike = counts.select(F.col(key), n.alias("n")).groupBy(key, "n").agg(F.count("*").cast("int").alias("copies"))
    return (
        alike.select(key, "n", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select(key, "n", "copy", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
        .withColumn("first_token", F.col("piece") * F.lit(capacity).cast("bigint"))
        .select(key, "piece", "first_token", F.least(F.col("n") - F.col("first_token"), F.lit(capacity)).alias("size"), F.concat_ws("-", F.coalesce(F.col(key).cast("string"), F.lit("null")), "n", "copy", "piece").alias("item"))
    )


def pack(counts: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens", tasks: int | None = None) -> DataFrame:
    """(key, piece, first_token, size, container, place, start): where every document goes.

    ``start`` is the token of the container the piece begins at, ``place`` its
    number there from 0. Documents are never divided unless larger than
    ``capacity``, which is that of one kind of container. Null and empty
    documents are placed with size 0. Rows with the same key are separate
    documents; a null key is kept. Ties in size are settled by item name.
    Empty input gives an empty frame.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = counts.sparkSession
    work = materialize(pieces(counts, capacity, key, size), "pack-items")
    whole = F.col("size") == capacity
    loose = work.filter(~whole)
    n_tasks = tasks or max(1, -(-loose.count() // ITEMS_PER_TASK))
    level = loose.select("item", "size", F.lit(1).cast("bigint").alias("docs")).repartition(n_tasks, F.xxhash64("item"))
    done_bins: DataFrame | None = None
    number = 0
    last = n_tasks == 1
    while True:
        placed = materialize(_round(level, capacity, number, last), f"pack-round{number}")
        done_bins = placed if done_bins is None else _lift(done_bins, placed)
        if last:
            break
        going = placed.filter(~F.col("done")).groupBy("bin").agg(F.first("fill").alias("size"), F.first("docs").alias("docs"))
        left = going.count()
        if not left:
            break
        # fewer tasks each round, unless that many bins are left that tasks would have to hold more than they should
        fewer = max(-(-n_tasks // FAN_IN), -(-left // ITEMS_PER_TASK))
        last = fewer == 1 or fewer >= n_tasks
        n_tasks = fewer
        number += 1
        level = going.select(F.col("bin").alias("item"), "size", "docs").repartition(n_tasks, F.xxhash64("item"))
    where = done_bins.select("item", F.col("bin").alias("container"), "place", "start")
    packed = work.filter(~whole).join(where, "item").select(key, "piece", "first_token", "size", "container", "place", "start")
    full = work.filter(whole).select(key, "piece", "first_token", "size", F.concat(F.lit("whole-"), "item").alias("container"), F.lit(0).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("start"))
    return packed.unionByName(full)


def _lift(below: DataFrame, placed: DataFrame) -> DataFrame:
    """Items of all rounds so far with their bins of the newest round: a bin that went on is an item of it."""
    up = placed.select(F.col("item").alias("bin"), F.col("bin").alias("up_bin"), F.col("start").alias("up_start"), F.col("place").alias("up_place"))

    def moved(new: str, add: bool) -> Column:
        old = F.col(new)
        return (F.coalesce(F.col("up_" + new), F.lit(0)) + old if add else F.coalesce(F.col("up_" + new), old)).alias(new)

    return below.join(up, "bin", "left").select("item", moved("bin", False), moved("start", True), moved("place", True))


def capacity_of(spark: SparkSession, sf_dir: str, container: str = "long") -> int:
    """capacity_tokens of the named container; a table of the few sizes there are."""
    row = spark.read.parquet(f"{sf_dir}/containers.parquet").filter(F.col("container") == container).agg(F.max("capacity_tokens")).first()
    if row is None or row[0] is None:
        raise ValueError(f"no container {container!r}")
    return int(row[0])


def packed_documents(spark: SparkSession, sf_dir: str, container: str = "long", path: str = DEFAULT_TOKENIZER) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(token_counts(docs, path=path), capacity_of(spark, sf_dir, container))


def fills(packed: DataFrame, capacity: int) -> DataFrame:
    """(container, documents, tokens, fill): how full every container is."""
    return packed.groupBy("container").agg(F.count("*").alias("documents"), F.sum("size").alias("tokens")).withColumn("fill", F.col("tokens") / F.lit(float(capacity)))
