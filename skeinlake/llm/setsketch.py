"""Operator 4: near duplicates by SetSketch registers.

A text's set is its three-word shingles after normalisation (lower case, runs of letters and digits).
Register i keeps the largest ``floor(1 - log_b(h_i))`` over the set, with ``h_i`` exponentially
distributed: truncated minima on an exponential scale. Registers of a union are the
maxima of the parts' registers, and equal sets have equal registers.

Search: texts with equal words collapse first; registers are cut into bands; texts that share a
band are candidates. Each candidate pair's Jaccard similarity is estimated from the counts of larger, smaller
and equal registers by joint maximum likelihood, which discards the unlikely, and the rest are verified on
the full shingle sets. Connected components of verified pairs are the groups.

In a band's bucket every member meets the smallest one. Whoever is not verified against it elects more
centers, eight times as many in each round, until nobody is left. What is near a center in one round is tried against what
was left over only where components differ and the distances to that center allow it (Jaccard distance is a metric). So
the components are those of all pairs in buckets, without all pairs being tried, and no bucket is gathered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skeinlake.llm import arrays as A
from skeinlake.llm import jobs, windows as W
from skeinlake.llm.components import connected_components

REGISTERS = 128
BASE = 1.001
RATE = 20.0
LIMIT = 65534
BANDS, ROWS = 32, 4
SHINGLE = 3
#: Standard deviations (at most 0.045 each) below the threshold at which an estimate discards a pair.
SLACK = 0.15
_SECOND = 0xA0761D6478BD642F

_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """Least of each register's 32-bit hash over a set."""
    x = (shingles >> A.U64(32)).astype(np.uint32)[:, None]
    best = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(best, ((x[at : at + 1024] ^ _XOR) * _MUL).min(axis=0), out=best)
    return best


def registers_of(least: np.ndarray) -> np.ndarray:
    """SetSketch registers from minima: the least exponential value on a logarithmic scale, truncated."""
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / math.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def cardinality(reg: np.ndarray) -> np.ndarray:
    """Size of each row's set."""
    return REGISTERS * (1 - 1 / BASE) / (RATE * math.log(BASE) * (BASE ** -reg.astype(np.float64)).sum(axis=1))


def joint_jaccard(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of register rows, from how many are larger, smaller and equal."""
    nu, nv = cardinality(u), cardinality(v)
    a, b = (nu / (nu + nv))[:, None], (nv / (nu + nv))[:, None]
    more, less = (u > v).sum(axis=1)[:, None], (u < v).sum(axis=1)[:, None]
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(a / b, b / a)
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(a - b * j), p(b - a * j)
    like = more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(np.maximum(1 - up - down, 1e-12))
    return j[np.arange(len(j)), like.argmax(axis=1)]


def shingle_sets(tok: A.Tokens) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingle hashes) of each row with a token; fewer than three tokens make one shingle."""
    sums = A.prefix(tok.hash)
    at = np.arange(max(0, len(tok.hash) - SHINGLE + 1))
    h = A.span_hash(sums, at, at + SHINGLE)
    for r, (a, b) in enumerate(zip(tok.first[:-1].tolist(), tok.first[1:].tolist())):
        if b - a >= SHINGLE:
            yield r, h[a : b - SHINGLE + 1]
        elif b > a:
            yield r, A.span_hash(sums, np.array([a]), np.array([b]))


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, words, registers): 128-bit hash of the word row, and the sketch. Texts without a word have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for at, part in A.normal_slices(batch.column(1)):
                tok = A.Tokens(part, A.WORDS)
                words = np.stack([A.span_hash(A.prefix(h), tok.first[:-1], tok.first[1:]) for h in (tok.hash, A.mix(tok.hash ^ A.U64(_SECOND)))], axis=1)
                row, least = [], []
                for r, s in shingle_sets(tok):
                    row.append(r)
                    least.append(minima(s))
                if row:
                    reg = registers_of(np.array(least))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc[at + np.array(row)], pa.int64()), pa.array([x.tobytes() for x in words[row]], pa.binary()),
                            pa.array([x.tobytes() for x in reg], pa.binary()),
                        ],
                        names=["doc_id", "words", "registers"],
                    )

    return W.texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, words binary, registers binary")


def bands(sketches: DataFrame) -> DataFrame:
    """(bucket, doc_id) of every band of every sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            reg = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            key = reg.reshape(len(reg), BANDS, ROWS).astype(np.uint64)
            h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(reg), 1))
            for k in range(ROWS):
                h = A.mix(h * A.U64(0x9E3779B97F4A7C15) + key[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(doc, BANDS))], names=["bucket", "doc_id"])

    return sketches.select("doc_id", "registers").mapInArrow(run, "bucket bigint, doc_id bigint")


def _estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, j): the joint estimate of each pair."""
    left = sketches.select(F.col("doc_id").alias("a"), F.col("registers").alias("u"))
    right = sketches.select(F.col("doc_id").alias("b"), F.col("registers").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                u, v = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(joint_jaccard(u, v))], names=["a", "b", "j"])

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "u", "v")
    return both.mapInArrow(run, "a bigint, b bigint, j double").groupBy("a", "b").agg(F.max("j").alias("j"))


def _set_of(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, tmp: jobs.Scratch) -> DataFrame:
    """(a, b, j): the Jaccard similarity of the shingle sets of each pair. Each a's set is sent once for up to 4096
    partners, and to the root of their number by 4096 where there are more; partners stream past it one by one."""
    fan = pairs.groupBy("a").agg(F.ceil(F.sqrt(F.count("*") / 4096)).cast("int").alias("fan"))
    salted = pairs.join(fan, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("fan")).cast("int"))
    members = salted.select(F.col("b").alias("doc_id"), "a", "salt", F.lit(1).alias("member"))
    centers = fan.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"), F.lit(0).alias("member"))
    wanted = tmp.save(members.unionByName(centers).groupBy("doc_id").agg(F.collect_list(F.struct("a", "salt", "member")).alias("to")))
    texts = jobs.join_small(W.texts_of(docs, id_col, text_col), wanted, "doc_id", "inner", 32 + 40 * F.size("to")).select("doc_id", "text", "to")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "salt", "member", "b", "shingles"]
        for batch in batches:
            doc = batch.column(0).to_pylist()
            to = batch.column(2).to_pylist()
            for at, part in A.normal_slices(batch.column(1)):
                rows, held = [], 0
                for r, s in shingle_sets(A.Tokens(part, A.WORDS)):
                    s = np.unique(s >> A.U64(16))
                    raw = s.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                    for x in to[at + r]:
                        rows.append((x["a"], x["salt"], x["member"], doc[at + r], raw))
                        held += len(raw)
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, center = None, []
        for batch in batches:
            left, right, alike = [], [], []
            for a, salt, member, b, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (a, salt) != now:
                    now, center = (a, salt), []
                other = _set_of(raw)
                if not member:
                    center.append(other)
                    continue
                for c in center:
                    at = np.minimum(np.searchsorted(c, other), len(c) - 1)
                    both = int(np.count_nonzero(c[at] == other))
                    left.append(a)
                    right.append(b)
                    alike.append(both / (len(c) + len(other) - both))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(alike, pa.float64())], names=["a", "b", "j"])

    sent = texts.mapInArrow(send, "a bigint, salt int, member int, b bigint, shingles binary")
    sorted_ = sent.repartition(jobs.tasks_for(docs, jobs.parts_for(docs)), "a", "salt").sortWithinPartitions("a", "salt", "member")
    return tmp.save(sorted_.mapInArrow(receive, "a bigint, b bigint, j double").groupBy("a", "b").agg(F.max("j").alias("j")))


def _measured(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str, tmp: jobs.Scratch) -> DataFrame:
    """(a, b, j, sure): true similarity where the estimate is near the threshold or above it, else the estimate."""
    guess = tmp.save(_estimated(pairs, sketches))
    likely = guess.where(F.col("j") >= threshold - SLACK).select("a", "b")
    true = _verified(likely, docs, id_col, text_col, tmp).withColumn("sure", F.col("j") >= threshold)
    return true.unionByName(guess.where(F.col("j") < threshold - SLACK).withColumn("sure", F.lit(False)))


def near_duplicates(
    docs: DataFrame, threshold: float, id_col: str, text_col: str, tmp: jobs.Scratch
) -> DataFrame:
    """(doc_id, keeper) of every member of a group of two or more; the keeper is its smallest doc_id."""
    sketches = tmp.save(sketch(docs, id_col, text_col))
    own = tmp.save(
        sketches.groupBy("words").agg(
            F.min("doc_id").alias("doc_id"), F.min_by("registers", "doc_id").alias("registers"), F.count("*").alias("n")
        )
    )
    leaders = own.where("n > 1").select("words", F.col("doc_id").alias("a"))
    links = jobs.join_small(sketches.select("words", F.col("doc_id").alias("b")), leaders, "words", "inner").where("a <> b").select("a", "b")
    reps = own.select("doc_id", "registers")
    left, met, centers = bands(reps), [], 1
    while True:
        groups = left.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
        groups = tmp.save(groups)
        is_center = F.col("doc_id") == F.col("first")
        if centers > 1:
            is_center |= F.pmod(F.xxhash64("doc_id", F.lit(centers)), F.ceil(F.col("n") / centers)) == 0
        members = tmp.save(jobs.join_small(left, groups, "bucket", "inner").select("bucket", "doc_id", is_center.alias("center")).distinct())
        if members.isEmpty():
            break
        heads = members.where("center").select("bucket", F.col("doc_id").alias("a"))
        pairs = tmp.save(
            jobs.join_small(members, heads, "bucket", "inner")
            .where("doc_id <> a AND (NOT center OR doc_id > a)")
            .select("bucket", "a", F.col("doc_id").alias("b"), "center")
        )
        measured = _measured(pairs.select("a", "b").distinct(), reps, docs, threshold, id_col, text_col, tmp)
        links = links.unionByName(measured.where("sure").select("a", "b"))
        round_ = tmp.save(pairs.join(measured, ["a", "b"]))
        left = round_.where("NOT center").groupBy("bucket", F.col("b").alias("doc_id")).agg(F.max("sure").alias("sure")).where("NOT sure").select("bucket", "doc_id")
        met.append(round_)
        centers *= 8
    groups = connected_components(links, tmp)
    return connected_components(links.unionByName(_missed(met, groups, reps, docs, threshold, id_col, text_col, tmp)), tmp, groups)


def _missed(
    met: list[DataFrame], groups: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str, tmp: jobs.Scratch
) -> DataFrame:
    """Links between those near a center and others that met it in the same bucket, where components differ."""
    links = "a bigint, b bigint"
    pairs = docs.sparkSession.createDataFrame([], links)
    keeper = lambda c: groups.select(F.col("doc_id").alias(c), F.col("keeper").alias(f"keeper_{c}"))
    apart = ~F.coalesce("keeper_a", "a").eqNullSafe(F.coalesce("keeper_b", "b"))
    for round_ in met:
        near = round_.where("sure").select("bucket", "a", F.col("b").alias("x"), F.col("j").alias("near"))
        far = round_.where("NOT sure").join(keeper("a"), "a", "left").join(keeper("b"), "b", "left").where(apart).select("bucket", "a", "b", "j")
        both = near.join(far, ["bucket", "a"]).where(F.col("near") <= F.col("j") + F.lit(1 - threshold + SLACK))
        pairs = pairs.unionByName(both.select(F.least("x", "b").alias("a"), F.greatest("x", "b").alias("b")))
    pairs = tmp.save(pairs.distinct())
    if pairs.isEmpty():
        return pairs
    return _measured(pairs, reps, docs, threshold, id_col, text_col, tmp).where("sure").select("a", "b")


def dedup_near(
    docs: DataFrame,
    threshold: float = 0.55,
    id_col: str = "doc_id",
    text_col: str = "text",
    copies_col: str | None = "near_copies",
) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Two texts are near duplicates if their three-word shingle sets have Jaccard similarity ``threshold``; groups
    are connected components. Returns the input's columns and ``near_copies``, the number of documents dropped
    for each one kept. Null ids, null texts and texts without a letter or digit are in no group and stay.
    Texts of fewer than three words are equal or not. Rows that repeat a doc_id are one document and stay or
    go together. An empty table gives an empty one; an input column named ``near_copies`` is replaced, other
    extra columns are kept.
    """
    with jobs.Scratch(docs.sparkSession) as tmp:
        groups = tmp.keep(near_duplicates(docs, threshold, id_col, text_col, tmp))
    size = groups.groupBy("keeper").agg((F.count("*") - 1).alias("__copies"))
    fate = groups.join(size, "keeper").select(
        F.col("doc_id").alias("__doc"), (F.col("doc_id") == F.col("keeper")).alias("__stays"), "__copies"
    )
    cols = [c for c in docs.columns if c != copies_col]
    keyed = docs.select(*cols, F.col(id_col).cast("bigint").alias("__doc"))
    kept = jobs.join_small(keyed, fate, "__doc", "left").where(F.coalesce("__stays", F.lit(True)))
    extra = [F.coalesce("__copies", F.lit(0)).alias(copies_col)] if copies_col else []
    return kept.select(*cols, *extra)
