"""Orders, samples, numbering, packing and fused rankings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skeinlake.storage import cut


def global_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their place, from 0, in one order over the whole table, without sorting in one task.

    Rows are range-partitioned and checkpointed, numbered within partitions, and shifted by the partitions before.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    counts = placed.groupBy("__p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offset = counts.select("__p", before.alias("__before"))  # one row a partition
    here = F.row_number().over(W.partitionBy("__p").orderBy(*order)) - 1
    return placed.withColumn(name, here).join(F.broadcast(offset), "__p").withColumn(name, F.col(name) + F.col("__before")).drop("__p", "__before")


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in a random order that depends on key and seed alone."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))


def draw_key(key: Column, weight: Column, seed: str = "0") -> Column:
    """Exponential key: by rising key, rows come in random order without replacement, odds by weight.

    The uniform number is the first 13 hexadecimal digits of an MD5, so that any engine draws the same.
    """
    digits = F.substring(F.md5(F.concat(F.lit(seed + "/"), key.cast("string")).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 1.0) / F.lit(float(16**13) + 1.0)
    return -F.log(u) / weight


def weighted_order(df: DataFrame, key: str, weight: str, seed: str = "0") -> DataFrame:
    """Rows of positive weight with ``draw``; order by it to sample."""
    return df.where(F.col(weight) > 0).withColumn("draw", draw_key(F.col(key), F.col(weight).cast("double"), seed))


def chunk_influence(hits: DataFrame, facts: DataFrame, k: int, on: str = "community_key", chunk: str = "chunk_id") -> DataFrame:
    """(chunk, influence): each hit's score spread over the chunks it comes from, by their share; the best ``k``.

    ``hits(on, score)``, ``facts(on, chunk, cnt)``. Totals are those of all facts of a hit. The hits are one query's top list.
    """
    mine = facts.join(F.broadcast(hits.select(on, "score")), on)
    total = F.sum("cnt").over(W.partitionBy(on)).cast("double")
    part = mine.withColumn("__part", F.col("score") * F.col("cnt") / total)
    return part.groupBy(chunk).agg(F.sum("__part").alias("influence")).orderBy(F.desc("influence"), chunk).limit(k)


NO_DOCUMENTS = "NO DOCUMENTS FOUND"


def with_sentinel(answers: DataFrame, **values: object) -> DataFrame:
    """The answers, or one row that says there are none: ``values`` by column, null elsewhere."""
    spark = answers.sparkSession
    none = spark.range(1).select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in answers.schema.fields))
    some = answers.limit(1).select(F.lit(1).alias("__some"))
    return answers.unionByName(none.join(F.broadcast(some), F.lit(True), "left_anti"))


def packed(items: Iterable[tuple[str, str, str]], limit: int = 4096) -> Iterator[dict]:
    """Blocks of (text, source, document) items in order, one after another. Each item counts its length and a line end.

    A block that an item would fill to the limit or past it is closed before the item. An item as long as the limit is a
    block of its own, and no block is empty.
    """
    now = {"block": "", "sources": [], "documents": []}
    size = 0
    for text, source, document in items:
        if now["block"] and size + len(text) + 1 >= limit:
            yield now
            now, size = {"block": "", "sources": [], "documents": []}, 0
        now["block"] += ("\n" if now["block"] else "") + text
        size += len(text) + 1
        for name, value in (("sources", source), ("documents", document)):
            if value is not None and value not in now[name]:
                now[name].append(value)
    if now["block"]:
        yield now


def pack_blocks(items: list[tuple[str, str, str]], limit: int = 4096) -> list[dict]:
    """The same as a list."""
    return list(packed(items, limit))


#: Texts of one lane of packing, which is one task, and blocks that a task hands on at once.
LANE_TEXTS = 20_000
HANDED_BLOCKS = 256


def global_blocks(rows: DataFrame, key: str, text: str, source: str, document: str, seed: int = 0, limit: int = 4096, lanes: int | None = None) -> DataFrame:
    """(lane, block_no, block, sources, documents): texts in random order, packed into blocks of up to ``limit`` characters.

    Packing is a fold in order, so texts are dealt to lanes by hash, one for each ``LANE_TEXTS`` texts unless ``lanes`` are
    given, and each lane packs its own; a lane's last block is the only one that may stay short. ``lanes=1`` packs
    everything in one order. A lane is sorted by Spark, which spills, and streams through the fold, which holds one block.
    """
    lanes = lanes or max(1, -(-rows.count() // LANE_TEXTS))
    dealt = rows.select(
        F.pmod(F.xxhash64(F.col(key)), F.lit(lanes)).cast("int").alias("lane"), F.xxhash64(F.col(key), F.lit(seed)).alias("o"),
        F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(source).cast("string").alias("s"), F.col(document).cast("string").alias("d"),
    ).where(F.col("t").isNotNull())

    columns = ["lane", "block_no", "block", "sources", "documents"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = (row for pdf in batches for row in zip(pdf["lane"], pdf["t"], pdf["s"], pdf["d"]))
        lane_blocks = (
            {"lane": lane, "block_no": i, **b} for lane, group in groupby(texts, key=lambda row: row[0]) for i, b in enumerate(packed((row[1:] for row in group), limit))
        )
        while some := list(islice(lane_blocks, HANDED_BLOCKS)):
            yield pd.DataFrame(some, columns=columns)

    schema = "lane int, block_no int, block string, sources array<string>, documents array<string>"
    return dealt.repartition(4 * lanes, "lane").sortWithinPartitions("lane", "o", "k").mapInPandas(run, schema)  # more partitions than lanes, so that few share one


def fuse(vector_hits: DataFrame, text_hits: DataFrame, key: str, k: int) -> DataFrame:
    """(key, score): each list's scores divided by its best, the better of the two counts; the best ``k``. Ties by key.

    Both lists are top lists of one query, so their best score is one row, broadcast.
    """
    parts = None
    for hits in (vector_hits, text_hits):
        best = hits.agg(F.max("score").alias("__best"))
        one = hits.join(F.broadcast(best)).select(key, F.when(F.col("__best") > 0, F.col("score") / F.col("__best")).otherwise(F.lit(0.0)).alias("score"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(k)


def batches_of(rows: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Regroup batches to at most ``size`` rows, for providers with a limit."""
    for pdf in rows:
        for at in range(0, len(pdf), size):
            yield pdf.iloc[at : at + size]
