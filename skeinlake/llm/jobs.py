"""Shared storage, size-checked joins, and exchange of packed arrays between partitions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A side of a join is broadcast only if its measured rows times their width stay below this.
BROADCAST_BYTES = 8 << 20
#: Input bytes of one bucket of an exchange, which a Python worker holds at once, and of one partition, which may have many.
BUCKET_BYTES = 10 << 20
PART_BYTES = 512 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a folder of our own in local mode; a cluster must set it."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if folder:
        if current is None:
            sc.setCheckpointDir(folder)
        return folder
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="skeinlake-"))
        current = sc.getCheckpointDir()
    return current


class Scratch:
    """Tables in the shared folder that end with the ``with`` block; what outlives it is checkpointed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/skeinlake-{uuid.uuid4().hex}"
        self.count = 0

    def __enter__(self) -> Scratch:
        return self

    def save(self, df: DataFrame) -> DataFrame:
        """Write a table and read it again."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        """A result that needs none of the scratch tables any more, in reliable checkpoint storage."""
        return df.checkpoint()

    def __exit__(self, *exc: object) -> None:
        _delete(self.spark, self.folder)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def size_of(df: DataFrame) -> int | None:
    """Bytes of a table by Spark's own statistics; None where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return None if size > 1 << 60 else size


def parts_for(df: DataFrame) -> int:
    """Buckets of an exchange over a table: they follow its bytes, so that each stays small."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size_of(df) or 0) // BUCKET_BYTES))


def tasks_for(df: DataFrame, buckets: int) -> int:
    """Partitions of an exchange: as many as buckets while these are few, later one for each ``PART_BYTES``."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(buckets, max(least, -(-buckets * BUCKET_BYTES // PART_BYTES)))


def join_small(big: DataFrame, small: DataFrame, on: str | list[str], how: str, row_bytes: Column | int = 64) -> DataFrame:
    """Join a materialised side: broadcast if its measured bytes stay below ``BROADCAST_BYTES``, else a shuffled join."""
    width = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    size = small.agg(F.sum(width.cast("bigint"))).first()[0] or 0
    return big.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, on, how)


ROUTED = "bucket int, kind int, payload binary"
Payloads = dict[int, list[bytes]]


def routed(bucket: np.ndarray, records: np.ndarray, kind: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Split a structured array by bucket into (bucket, kind, bytes)."""
    order = np.argsort(bucket, kind="stable")
    records = records[order]
    at, size = np.unique(bucket, return_counts=True)
    end = np.cumsum(size)
    for p, a, b in zip(at.tolist(), (end - size).tolist(), end.tolist()):
        yield p, kind, records[a:b].tobytes()


def to_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, kind, payload = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())],
        names=["bucket", "kind", "payload"],
    )


def records_of(payloads: list[bytes], dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(payloads), dtype)


def by_bucket(receive: Callable[[Payloads], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by bucket: ``receive`` gets the payloads of one bucket by kind, then those of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for b in batches:
            for bucket, kind, x in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "payload"))):
                if bucket != now:
                    if held:
                        yield from receive(held)
                    now, held = bucket, {}
                held.setdefault(kind, []).append(x)
        if held:
            yield from receive(held)
        pa.default_memory_pool().release_unused()

    return run


def exchange(
    df: DataFrame,
    send: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    buckets: int,
    receive: Callable[[Payloads], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``send`` emits ROUTED rows; each bucket goes whole to one call of ``receive``. A partition takes one bucket
    after another, sorted on the JVM's side, so its size doesn't matter to the Python worker."""
    tasks = tasks_for(df, buckets)
    sent = df.mapInArrow(send, ROUTED).repartitionById(tasks, F.col("bucket") % tasks)
    if tasks < buckets:
        sent = sent.sortWithinPartitions("bucket")
    return sent.mapInArrow(by_bucket(receive), schema)
