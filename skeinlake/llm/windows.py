"""Content-partitioned windows: the common ground of the two repeat removers.

A text is a row of tokens (runs of non-space bytes). Each window of 50 tokens or more belongs to
the least hash among its ``SEED``-token grams. Equal windows have equal least grams, so hashing that
gram to a bucket brings all copies of a window together, and neighbouring windows mostly share
it: consecutive windows of one gram (about 13, at 50 tokens) form a *run* that travels as one record with 5
bytes a window. Nothing is sampled: every window of every text is in exactly one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skeinlake.llm import arrays as A
from skeinlake.llm import jobs

WINDOW = 50
SEED = 25
RUN = np.dtype([("doc", "<i8"), ("start", "<i4"), ("next", "<i4"), ("hash", "<u8")])
_HEAD = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("count", "<i4")])
_FLUSH = 600_000
RUNS, COPIES = 0, 1


class Runs:
    """Runs as arrays: ``gram``, ``doc``, ``start``, ``count``, ``multi`` (its gram occurs twice inside), ``hash``; ``win`` in order."""

    def __init__(self, gram, doc, start, count, multi, hash_, win):
        self.gram, self.doc, self.start, self.count = gram, doc, start, count
        self.multi, self.hash, self.win = multi, hash_, win

    def __len__(self) -> int:
        return len(self.gram)

    def at(self) -> np.ndarray:
        return np.cumsum(self.count, dtype=np.int64) - self.count

    def take(self, pick: np.ndarray) -> Runs:
        at = self.at()[pick]
        return Runs(
            self.gram[pick], self.doc[pick], self.start[pick], self.count[pick], self.multi[pick],
            None if self.hash is None else self.hash[pick], self.win[A.ragged(at, self.count[pick])],
        )

    @staticmethod
    def concat(many: list[Runs]) -> Runs:
        join = lambda f: np.concatenate([getattr(x, f) for x in many])
        return Runs(*(join(f) for f in ("gram", "doc", "start", "count", "multi", "hash", "win")))


def slice_runs(texts: pa.Array, doc: np.ndarray, window: int = WINDOW, at: tuple | None = None, whole: bool = True) -> Runs | None:
    """Runs of one slice of texts; None where there is none. ``at`` is (row, first, end) of the places where windows
    may start, in order; without it all may. ``whole``: with the hashes of windows."""
    tok = A.Tokens(texts, A.SPACED)
    size = np.diff(tok.first)
    if at is None:
        row, first, count = np.arange(len(size)), np.zeros(len(size), np.int64), np.maximum(0, size - window + 1)
    else:
        row, first = at[0], at[1]
        count = np.maximum(0, np.minimum(at[2], size[row] - window + 1) - first)
    if not count.any():
        return None
    sums = A.prefix(tok.hash)
    grams = A.span_hash(sums, np.arange(len(tok.hash) - SEED + 1), np.arange(SEED, len(tok.hash) + 1))
    least = A.sliding_min(grams, window - SEED + 1)
    idx = A.ragged(tok.first[row] + first, count)
    row = np.repeat(row, count)
    value = least[idx]
    new = np.ones(len(idx), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1]) | (np.diff(idx) != 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(idx)))
    begin, final = idx[first], idx[first] + count - 1
    wide = np.arange(window - SEED + 1)
    multi = np.empty(len(first), bool)
    for a in range(0, len(first), 1 << 14):
        b = slice(a, a + (1 << 14))
        left = grams[begin[b, None] + wide].argmin(axis=1) + begin[b]
        multi[b] = left != grams[final[b, None] + wide].argmin(axis=1) + final[b]
    r = row[first]
    win = A.span_hash(sums, idx, idx + window) >> A.U64(24) if whole else np.zeros(0, np.uint64)
    runs = Runs(value[first], doc[r], (begin - tok.first[r]).astype(np.int32), count.astype(np.int32), multi, None, win)
    if whole:
        runs.hash = run_hash(runs)
    return runs


def run_hash(runs: Runs) -> np.ndarray:
    """Equal for runs of equal windows."""
    at = runs.at()
    return A.span_hash(A.prefix(symbols(runs)), at, at + runs.count)


def _pack(runs: Runs, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    bucket = bucket_of(runs.gram, buckets)
    runs = runs.take(np.argsort(bucket, kind="stable"))
    used, size = np.unique(bucket, return_counts=True)
    end = np.cumsum(size)
    at = np.append(runs.at(), len(runs.win))
    head = np.empty(len(runs), _HEAD)
    head["gram"], head["doc"], head["start"] = runs.gram, runs.doc, runs.start
    head["count"] = np.where(runs.multi, -runs.count, runs.count)
    packed = runs.win.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    for p, a, b in zip(used.tolist(), (end - size).tolist(), end.tolist()):
        yield p, RUNS, np.int64(b - a).tobytes() + head[a:b].tobytes() + packed[at[a] : at[b]].tobytes()


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    return ((gram >> A.U64(20)) % A.U64(buckets)).astype(np.int64)


def unpack(payloads: list[bytes]) -> Runs | None:
    """Runs of a bucket, sorted by document and start, the same run of the same place once."""
    heads, wins = [], []
    for x in payloads:
        n = int(np.frombuffer(x, np.int64, 1)[0])
        head = np.frombuffer(x, _HEAD, n, 8)
        raw = np.frombuffer(x, np.uint8, offset=8 + n * _HEAD.itemsize).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        heads.append(head)
        wins.append(wide.view("<u8").ravel())
    if not heads:
        return None
    head = np.concatenate(heads)
    count = np.abs(head["count"])
    runs = Runs(head["gram"], head["doc"], head["start"], count, head["count"] < 0, None, np.concatenate(wins))
    order = np.lexsort((runs.gram, runs.start, runs.doc))
    place = np.stack([runs.doc, runs.start, runs.gram.view(np.int64), runs.count])[:, order]
    again = np.flatnonzero((place[:, 1:] == place[:, :-1]).all(axis=0))
    fresh = np.ones(len(order), bool)
    if len(again):  # a repeated row of the table has the same runs at the same places again
        of = run_hash(runs)[order]
        many = np.unique(np.concatenate([again, again + 1]))
        order[many] = order[many][np.lexsort((of[many], *place[::-1, many]))]
        of = run_hash(runs)[order]
        fresh[again + 1] = of[again] != of[again + 1]
    return runs.take(order[fresh])


def symbols(runs: Runs) -> np.ndarray:
    """One 64-bit value a window, equal for equal windows."""
    return A.mix(np.repeat(runs.gram, runs.count) + runs.win * A.U64(0x9E3779B97F4A7C15))


def send(buckets: int, window: int = WINDOW):
    """Map side: (doc_id, text) batches, or (doc_id, text, spans of window starts), to packed runs. Of equal runs in
    a task the first goes out whole; the others are copies for certain and go out as bare records, so that a hot
    passage costs little."""

    def flush(buffer: list[Runs]) -> pa.RecordBatch:
        runs = Runs.concat(buffer)
        buffer.clear()
        order = np.lexsort((runs.start, runs.doc, runs.hash))
        h = runs.hash[order]
        later = np.zeros(len(runs), bool)
        place = (runs.doc[order], runs.start[order])
        lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        lead = np.repeat(lead, np.diff(np.append(lead, len(h))))
        later[order] = (place[0] != place[0][lead]) | (place[1] != place[1][lead])
        rows = list(_pack(runs.take(np.flatnonzero(~later)), buckets))
        if later.any():
            copy = np.empty(int(later.sum()), RUN)
            copy["doc"], copy["start"] = runs.doc[later], runs.start[later]
            copy["next"], copy["hash"] = runs.start[later] + runs.count[later], runs.hash[later]
            rows += jobs.routed(bucket_of(runs.gram[later], buckets), copy, COPIES, buckets)
        return jobs.to_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer: list[Runs] = []
        held = 0
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            spans = batch.column(2) if batch.num_columns > 2 else None
            for at, texts in A.slices(batch.column(1)):
                where = None if spans is None else flat_spans(spans.slice(at, len(texts)))
                runs = slice_runs(texts, doc[at : at + len(texts)], window, where)
                if runs is not None:
                    buffer.append(runs)
                    held += len(runs.win)
                if held > _FLUSH:
                    yield flush(buffer)
                    held = 0
        if buffer:
            yield flush(buffer)

    return run


def flat_spans(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of a column of span lists."""
    flat = lists.flatten()
    count = np.diff(lists.offsets.to_numpy())
    start, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    return np.repeat(np.arange(len(lists)), count), start, end


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of rows that can take part: null ids and null texts stay out."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    )


def span_batch(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
        names=["doc_id", "start", "end"],
    )


SPANS = "doc_id bigint, start int, end int"


BY_DOCUMENT = "doc_id bigint, __spans array<struct<start:int,end:int>>"


def span_lists(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row a document from spans sorted by document."""
    at, _ = A.runs_of(doc)
    pairs = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)), pa.int32()), pairs)
    return pa.RecordBatch.from_arrays([pa.array(doc[at], pa.int64()), lists], names=["doc_id", "__spans"])


def by_document(spans: DataFrame, tasks: int) -> DataFrame:
    """One row a document: its spans in order, overlapping and touching ones merged."""

    def merged(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if held:
            yield span_lists(*A.merge_spans(*(np.concatenate([g[i] for g in held]) for i in range(3))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        for b in batches:
            got = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            if n + b.num_rows > 1_000_000 and held:  # rows are sorted: what comes before the last document is complete
                every = [np.concatenate([g[i] for g in [*held, got]]) for i in range(3)]
                cut = int(np.searchsorted(every[0], every[0][-1]))
                yield from merged([[x[:cut] for x in every]] if cut else [])
                held, n = [[x[cut:] for x in every]], len(every[0]) - cut
            elif b.num_rows:
                held.append(got)
                n += b.num_rows
        yield from merged(held)

    kept = spans.select("doc_id", "start", "end").repartition(tasks, "doc_id").sortWithinPartitions("doc_id")
    return kept.mapInArrow(run, BY_DOCUMENT)


def _cut(raw: bytes, start: np.ndarray, end: np.ndarray, spans: list[dict]) -> tuple[str, int]:
    """Remove token spans with what follows up to the next token; the rest stays byte for byte."""
    out, at, removed, reach = [], 0, 0, 0
    for s in spans:
        a, b = max(s["start"], reach), min(s["end"], len(start))
        if a >= b:
            continue
        out.append(raw[at : start[a]])
        at = max(at, start[b] if b < len(start) else len(raw))
        removed += b - a
        reach = b
    out.append(raw[at:])
    return b"".join(out).decode(), removed


def remove_spans(
    docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, removed_col: str, kind: str = A.SPACED
) -> DataFrame:
    """Cut spans out of texts. Documents without spans never leave the JVM; a document of which nothing
    but white space is left is dropped. ``removed_col`` counts the tokens cut; a column of that name is replaced."""
    cols = [c for c in docs.columns if c != removed_col]
    keyed = docs.select(*cols, F.col(id_col).cast("bigint").alias("__doc"))
    spans = spans.withColumnRenamed("doc_id", "__doc")
    marked = jobs.join_small(keyed, spans, "__doc", "left", 64 + 40 * F.size("__spans")).select(*cols, "__spans")
    clean = marked.where(F.col("__spans").isNull()).select(*cols, F.lit(0).cast("int").alias(removed_col))

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_text = batch.schema.get_field_index(text_col)
            texts = A.as_strings(batch.column(at_text))
            spans_of = batch.column(batch.schema.get_field_index("__spans")).to_pylist()
            new, gone = [], []
            for at, part in A.slices(texts):
                tok = A.Tokens(part, kind, hashed=False)
                for i, text in enumerate(part.to_pylist()):
                    if kind == A.WORDS and not text.isascii():
                        start, end = A.word_places(text)
                    else:
                        a, b = tok.first[i], tok.first[i + 1]
                        start, end = tok.start[a:b] - tok.offsets[i], tok.end[a:b] - tok.offsets[i]
                    t, n = _cut(text.encode(), start, end, spans_of[at + i])
                    new.append(t)
                    gone.append(n)
            left = pa.array([bool(t.strip()) for t in new], pa.bool_())
            columns = [
                pa.array(new, f.type) if f.name == text_col else batch.column(i)
                for i, f in enumerate(batch.schema)
                if f.name != "__spans"
            ]
            names = [f.name for f in batch.schema if f.name != "__spans"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int32())], names=[*names, removed_col]).filter(left)

    schema = marked.select(*cols, F.lit(0).alias(removed_col)).schema
    edited = marked.where(F.col("__spans").isNotNull()).mapInArrow(edit, schema)
    return clean.unionByName(edited)
