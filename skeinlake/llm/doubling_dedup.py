"""Operator 10: repeated passages by level-wise doubling.

Level 25: of each 50-token window the least of its 25-token windows stands for it; only hashes of these travel.
Level 50: windows whose 25-token window is repeated. Level 100: windows put together from two repeated
windows of 50 tokens, end to end; then 200, and so on, each level from the survivors of the one
before and from nothing else, until no candidate survives. Windows that are repeated at level 50 and also occur
earlier are cut; the level at which a document's last window was repeated tells how long its longest repeat is.

A level reads only texts that still have candidates, and ships only candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skeinlake.llm import arrays as A
from skeinlake.llm import jobs, windows as W

LEVEL = "kind int, doc_id bigint, start int, end int"
CUT, LIVE = 0, 1
_GRAM = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("count", "<i4")])
_OPEN, _LEADER, _CERTAIN, _MULTI = 0, 1, 2, 3


def _rows(kind: int, doc, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(doc), kind, np.int32)), pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
        names=["kind", "doc_id", "start", "end"],
    )


def _twice(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(values)
    _, size = A.runs_of(values[order])
    out = np.zeros(len(values), bool)
    out[order] = np.repeat(size > 1, size)
    return out


def _send_seeds(buckets: int):
    """Level 25, map side: each run's gram. Of equal grams in a task one speaks for all; the others are
    repeated for certain and travel by document, so that a hot gram doesn't load one bucket."""

    def flush(rec: np.ndarray, multi: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(rec["gram"], kind="stable")
        rec, multi = rec[order], multi[order]
        at, size = A.runs_of(rec["gram"])
        lead = np.zeros(len(rec), bool)
        lead[at] = True
        many = np.repeat(size > 1, size)
        known = multi & ~many
        rows = []
        for kind, pick in ((_OPEN, lead & ~many & ~multi), (_LEADER, lead & many), (_CERTAIN, ~lead), (_MULTI, known)):
            key = A.mix(rec["doc"][pick].view(np.uint64)) if kind == _CERTAIN else rec["gram"][pick]
            rows += jobs.routed(W.bucket_of(key, buckets), rec[pick], kind, buckets)
        return jobs.to_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        multi: list[np.ndarray] = []
        n = 0
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for at, texts in A.slices(batch.column(1)):
                runs = W.slice_runs(texts, doc[at : at + len(texts)], whole=False)
                if runs is not None:
                    rec = np.empty(len(runs), _GRAM)
                    rec["gram"], rec["doc"], rec["start"], rec["count"] = runs.gram, runs.doc, runs.start, runs.count
                    held.append(rec)
                    multi.append(runs.multi)
                    n += len(rec)
                if n > 1_000_000:
                    yield flush(np.concatenate(held), np.concatenate(multi))
                    held, multi, n = [], [], 0
        if held:
            yield flush(np.concatenate(held), np.concatenate(multi))

    return run


def _live_seeds(got: jobs.Payloads) -> Iterator[pa.RecordBatch]:
    """Level 25: runs whose gram is repeated, as spans of window starts."""
    rec = jobs.records_of(got.get(_OPEN, []), _GRAM)
    sure = jobs.records_of(got.get(_LEADER, []) + got.get(_MULTI, []), _GRAM)
    live = [sure, jobs.records_of(got.get(_CERTAIN, []), _GRAM)]
    if len(rec):
        live.append(rec[_twice(rec["gram"]) | np.isin(rec["gram"], sure["gram"])])
    live = np.concatenate(live)
    if len(live):
        yield W.span_batch(live["doc"], live["start"], live["start"] + live["count"])


def _live_windows(window: int):
    """A level of 50 tokens or more in one bucket: later copies to cut, and spans of starts of repeated windows."""

    def receive(got: jobs.Payloads) -> Iterator[pa.RecordBatch]:
        copies = jobs.records_of(got.get(W.COPIES, []), W.RUN)
        runs = W.unpack(got.get(W.RUNS, []))
        if len(copies):
            yield _rows(LIVE, copies["doc"], copies["start"], copies["next"])
            yield _rows(CUT, copies["doc"], copies["start"], copies["next"].astype(np.int64) + window - 1)
        if runs is None:
            return
        sym = W.symbols(runs)
        order = np.argsort(sym, kind="stable")  # places are in text order, so the first of equals is the earliest
        at, size = A.runs_of(sym[order])
        twice, later = np.zeros(len(sym), bool), np.ones(len(sym), bool)
        twice[order] = np.repeat(size > 1, size)
        later[order[at]] = False
        if len(copies):
            twice |= np.repeat(np.isin(W.run_hash(runs), copies["hash"]), runs.count)
        run = np.repeat(np.arange(len(runs)), runs.count)
        place = (runs.start[run] + np.arange(len(sym)) - runs.at()[run]).astype(np.int64)
        for kind, pick, reach in ((LIVE, twice, 1), (CUT, later, window)):
            i = np.flatnonzero(pick)
            if len(i):
                yield _rows(kind, *A.merge_spans(runs.doc[run[i]], place[i], place[i] + reach))

    return receive


def _doubled(window: int):
    """From the starts of repeated windows those at which another one follows end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            row, start, end = W.flat_spans(batch.column(1))
            if not len(row):
                continue
            wide = np.int64(end.max() + window + 1)
            left, right = row * wide + start, row * wide + end  # disjoint and in order, on one axis
            a, b = left + window, right + window
            first, last = np.searchsorted(right, a, "right"), np.searchsorted(left, b, "left")
            count = np.maximum(0, last - first)
            i, j = np.repeat(np.arange(len(row)), count), A.ragged(first, count)
            lo, hi = np.maximum(a[i], left[j]) - window, np.minimum(b[i], right[j]) - window
            if len(i):
                yield W.span_lists(doc[row[i]], lo - row[i] * wide, hi - row[i] * wide)

    return run


def repeats(docs: DataFrame, id_col: str, text_col: str, tmp: jobs.Scratch, levels: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Spans to cut by document, and (doc_id, longest) for documents with a repeated window, from all levels if wanted."""
    buckets = jobs.parts_for(docs)
    tasks = jobs.tasks_for(docs, buckets)
    texts = W.texts_of(docs, id_col, text_col)
    seeds = jobs.exchange(texts, _send_seeds(buckets), buckets, _live_seeds, W.SPANS)
    found = tmp.save(W.by_document(seeds, tasks))
    window, cut, longest = W.WINDOW, None, []
    while True:
        texts = jobs.join_small(texts, found, "doc_id", "inner", 64 + 16 * F.size("__spans")).select("doc_id", "text", "__spans")
        if levels and window > W.WINDOW:
            texts = tmp.save(texts)
        level = tmp.save(jobs.exchange(texts, W.send(buckets, window), buckets, _live_windows(window), LEVEL))
        if cut is None:
            cut = tmp.keep(W.by_document(level.where(F.col("kind") == CUT), tasks))
        if not levels:
            return cut, None
        live = tmp.save(W.by_document(level.where(F.col("kind") == LIVE), tasks))
        longest.append(live.select("doc_id", F.lit(window).alias("longest")))
        found = tmp.save(live.mapInArrow(_doubled(window), W.BY_DOCUMENT))
        if found.isEmpty():
            break
        texts = texts.select("doc_id", "text")
        window *= 2
    every = longest[0]
    for more in longest[1:]:
        every = every.unionByName(more)
    return cut, tmp.keep(every.groupBy("doc_id").agg(F.max("longest").alias("longest")))


def dedup_doubling(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    removed_col: str = "removed_tokens",
    longest_col: str | None = "longest_repeat",
) -> DataFrame:
    """Documents without later copies of passages of 50 tokens or more.

    Returns the input's columns with the text cut, ``removed_tokens``, and ``longest_repeat``: the greatest of
    50, 100, 200, ... tokens of which a window of the text as it was occurs more than once; null where none of 50
    does. Without ``longest_col`` the levels end at 50, which decides what is cut. The earliest copy by (doc_id,
    position) stays. Tokens are split at ASCII white space and compared as they stand. Null ids and null,
    empty or shorter texts are returned as they are. Documents that consist of copies alone are
    dropped. Rows that repeat a doc_id are one document: what is equal at the same place isn't a copy, and
    cuts, by token places, hold for all of them, also where their texts differ. An empty table gives an empty
    one; input columns named like the added ones are replaced, other extra columns are kept.
    """
    with jobs.Scratch(docs.sparkSession) as tmp:
        spans, longest = repeats(docs, id_col, text_col, tmp, longest_col is not None)
    if longest_col:
        kept = [c for c in docs.columns if c != longest_col]
        keyed = docs.select(*kept, F.col(id_col).cast("bigint").alias("__doc2"))
        longest = longest.select(F.col("doc_id").alias("__doc2"), F.col("longest").alias(longest_col))
        docs = jobs.join_small(keyed, longest, "__doc2", "left").select(*kept, longest_col)
    return W.remove_spans(docs, spans, id_col, text_col, removed_col)
