"""Operator 6: conflict-constrained best-fit packing.

Texts are cut into pieces of at most ``capacity`` tokens and packed, longest first, into bins. Open bins are kept
in order of residual capacity; each carries a bitmap of the sources and one of the duplicate clusters in it. A
piece looks for its successor, the bin of least sufficient residual, and goes on upwards, over ever longer stretches of
bins at once, until a bin holds neither its source nor its cluster: the tightest compatible one. Without one it opens a bin.

Packing runs in blocks of about ``block`` pieces, so bins never wait for each other across the cluster; only
lengths, sources and clusters travel, not texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skeinlake.llm import arrays as A
from skeinlake.llm import jobs


def best_fit(size: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece; pieces must come in order of falling size."""
    n = len(size)
    bits = []  # for each piece the bitmaps, over the bins, of its source and its cluster, if they come twice
    for key in (source, cluster):
        _, of, count = np.unique(key, return_inverse=True, return_counts=True)
        maps = [np.zeros(n, bool) if c > 1 else None for c in count]
        bits.append([maps[k] for k in of.ravel().tolist()])
    residual, bins = np.empty(n, np.int64), np.empty(n, np.int64)  # of open bins, in order of residual and number
    out = np.empty(n, np.int64)
    held = made = 0
    smallest = int(size[-1]) if n else 0
    for p, (need, s, c) in enumerate(zip(size.tolist(), *bits)):
        at = int(np.searchsorted(residual[:held], need))
        step, found = 64, -1
        while at < held:
            some = bins[at : min(at + step, held)]
            full = s[some] if s is not None else np.zeros(len(some), bool)
            if c is not None:
                full = full | c[some]
            k = int(full.argmin())
            if not full[k]:
                found = at + k
                break
            at += len(some)
            step *= 8
        if found < 0:
            b, left = made, capacity - need
            made += 1
        else:
            b, left = int(bins[found]), int(residual[found]) - need
            residual[found : held - 1], bins[found : held - 1] = residual[found + 1 : held].copy(), bins[found + 1 : held].copy()
            held -= 1
        for x in (s, c):
            if x is not None:
                x[b] = True
        out[p] = b
        if left >= smallest:
            at, end = (int(np.searchsorted(residual[:held], left, side)) for side in ("left", "right"))
            at += int(np.searchsorted(bins[at:end], b))
            residual[at + 1 : held + 1], bins[at + 1 : held + 1] = residual[at:held].copy(), bins[at:held].copy()
            residual[at], bins[at] = left, b
            held += 1
    return out


def _lengths(docs: DataFrame, id_col: str, text_col: str, source_col: str, cluster_col: str | None) -> DataFrame:
    cluster = F.xxhash64(F.col(cluster_col).cast("string")) if cluster_col else F.lit(0).cast("bigint")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(source_col).cast("string")).alias("source"),
        cluster.alias("cluster"), F.col(text_col).cast("string").alias("text"),
    ).where("doc_id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in A.slices(batch.column(3)):
                n = np.diff(A.Tokens(part, A.SPACED, hashed=False).first)
                rest = batch.slice(at, len(part))
                group = rest.column(2)
                if cluster_col is None:
                    tok = A.Tokens(A.normalised(part), A.WORDS)
                    group = pa.array(A.span_hash(A.prefix(tok.hash), tok.first[:-1], tok.first[1:]).view(np.int64))
                columns = [rest.column(0), rest.column(1), group, pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "cluster", "n"]).filter(pa.array(n > 0))

    return rows.mapInArrow(run, "doc_id bigint, source bigint, cluster bigint, n bigint")


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    block: int = 8192,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
) -> DataFrame:
    """(bin, doc_id, piece, first_token, tokens) for every piece of every text.

    Tokens are split at ASCII white space. No bin exceeds ``capacity``, and no two pieces in a bin share a source or
    a duplicate cluster: ``cluster_col``, or else equal words after normalisation. Null sources are one
    source. Null ids and texts without a token are not packed. Ties of length go by doc_id and piece.
    Rows that repeat a doc_id are packed one by one. Texts go to as many blocks of equal chance as hold ``block`` of them each.
    An empty table gives no bins; extra columns don't matter.
    """
    with jobs.Scratch(docs.sparkSession) as tmp:
        lengths = tmp.save(_lengths(docs, id_col, text_col, source_col, cluster_col))
        blocks = max(1, -(-lengths.count() // block))

        def run(table: pa.Table) -> pa.Table:
            doc, source, cluster, n, part = (table.column(c).to_numpy() for c in ("doc_id", "source", "cluster", "n", "block"))
            pieces = -(-n // capacity)
            i = np.repeat(np.arange(len(n)), pieces)
            piece = A.ragged(np.zeros(len(n), np.int64), pieces)
            size = np.minimum(capacity, n[i] - piece * capacity)
            order = np.lexsort((piece, cluster[i], source[i], doc[i], -size))
            i, piece, size = i[order], piece[order], size[order]
            bins = best_fit(size, source[i], cluster[i], capacity)
            return pa.table(
                {
                    "bin": pa.array(part[i].astype(np.int64) * (1 << 32) + bins), "doc_id": pa.array(doc[i]),
                    "piece": pa.array(piece, pa.int32()), "first_token": pa.array(piece * capacity, pa.int64()), "tokens": pa.array(size, pa.int64()),
                }
            )

        equal = lengths.groupBy("doc_id", "source", "cluster", "n").agg(F.count("*").alias("rows"))
        thousands = F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / 1000))).alias("thousand")  # rows that repeat go to blocks of their own
        copies = F.explode(F.sequence(F.lit(0), F.least(F.lit(999), F.col("rows") - 1 - F.col("thousand") * 1000))).alias("copy")
        single = equal.select("*", thousands).select("*", copies)
        of = F.pmod(F.xxhash64("doc_id", "n", F.col("thousand") * 1000 + F.col("copy")), F.lit(blocks)).cast("int").alias("block")
        packed = single.select("doc_id", "source", "cluster", "n", of).groupBy("block").applyInArrow(run, "bin bigint, doc_id bigint, piece int, first_token bigint, tokens bigint")
        return tmp.keep(packed)
