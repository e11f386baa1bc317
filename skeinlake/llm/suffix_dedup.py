"""Operator 3: repeated passages by longest-previous-factor arrays.

Suffixes are partitioned by the least 25-token gram of their first 50 tokens (``windows``), so
suffixes that share 50 tokens or more meet in one bucket. There they are sorted into a suffix
array by prefix doubling over window symbols, neighbours get their longest common prefix, and
previous and next smaller text positions in suffix order give each suffix its longest previous
factor: the longest prefix that also starts earlier, in order of (doc_id, position). Factors of 50
tokens or more are cut; the earliest copy always stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skeinlake.llm import arrays as A
from skeinlake.llm import jobs, windows as W

#: Suffixes are compared over so many window symbols past the first; longer factors chain, because
#: the suffixes that start inside them have factors of their own.
HORIZON = 64


def suffix_ranks(symbol: np.ndarray, left: np.ndarray, horizon: int = HORIZON) -> list[np.ndarray]:
    """Ranks of substrings of 1, 2, 4, ... symbols from each place; ``left[i]`` symbols remain from i to its end."""
    order = np.argsort(symbol, kind="stable")
    s = symbol[order]
    rank = np.empty(len(s), np.int64)
    rank[order] = np.cumsum(np.concatenate([[1], (s[1:] != s[:-1]).astype(np.int64)]))
    ranks, k, n = [rank], 1, len(s)
    longest = int(left.max())
    while k < min(horizon, longest) and rank.max() < n:
        second = np.zeros(n, np.int64)
        more = np.flatnonzero(left > k)
        second[more] = rank[more + k]
        pair = rank * (n + 1) + second
        order = np.argsort(pair)
        s = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (s[1:] != s[:-1]).astype(np.int64)]))
        ranks.append(rank)
        k *= 2
    return ranks


def neighbour_lcp(ranks: list[np.ndarray], left: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common symbols of each suffix in the array with the one before it; 0 for the first."""
    a, b = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(len(a), np.int64)
    live = np.ones(len(a), bool)
    for level in range(len(ranks) - 1, -1, -1):
        i = np.flatnonzero(live)
        i = i[ranks[level][a[i]] == ranks[level][b[i]]]
        step = np.minimum(1 << level, left[a[i]])
        lcp[i] += step
        done = (left[a[i]] == step) | (left[b[i]] == step)
        live[i[done]] = False
        go = i[~done]
        a[go] += step[~done]
        b[go] += step[~done]
    return np.concatenate([[0], lcp])


def smaller_before(value: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each entry of a suffix array, the common prefix with the nearest entry before it of smaller value."""
    prev = np.arange(len(value)) - 1
    least = lcp.copy()
    active = np.flatnonzero((least > 0) & (prev >= 0))
    active = active[value[prev[active]] > value[active]]
    while len(active):
        p = prev[active]
        least[active] = np.minimum(least[active], least[p])
        prev[active] = prev[p]
        active = active[(least[active] > 0) & (prev[active] >= 0)]
        active = active[value[prev[active]] > value[active]]
    least[prev < 0] = 0
    return least


def previous_factors(symbol: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Longest previous factor of each place, in symbols. Places are in text order."""
    n = len(symbol)
    if n == 0:
        return np.zeros(0, np.int64)
    ranks = suffix_ranks(symbol, left)
    sa = np.argsort(ranks[-1], kind="stable")
    lcp = neighbour_lcp(ranks, left, sa)
    before = smaller_before(sa, lcp)
    # next smaller: the same from the other end, where an entry's common prefix is with the one after it
    after = smaller_before(sa[::-1], np.concatenate([[0], lcp[1:][::-1]]))[::-1]
    out = np.empty(n, np.int64)
    out[sa] = np.maximum(before, after)
    return out


def receive(got: jobs.Payloads) -> Iterator[pa.RecordBatch]:
    """Spans of later copies in one bucket."""
    doc, start, end = [], [], []
    runs = W.unpack(got.get(W.RUNS, []))
    if runs is not None:
        sym = W.symbols(runs)
        order = np.argsort(sym)
        at, size = A.runs_of(sym[order])
        twice = np.zeros(len(sym), bool)
        twice[order] = np.repeat(size > 1, size)
        place = np.flatnonzero(twice)  # a window that occurs once has no previous factor
        if len(place):
            run = np.searchsorted(np.cumsum(runs.count), place, "right")
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(place) > 1) | (np.diff(run) > 0)]))
            size = np.diff(np.append(cut, len(place)))
            left = np.repeat(cut + size, size) - np.arange(len(place))
            factor = previous_factors(sym[place], left)
            hit = np.flatnonzero(factor > 0)
            r = run[hit]
            first = (runs.start[r] + place[hit] - runs.at()[r]).astype(np.int64)
            doc.append(runs.doc[r])
            start.append(first)
            end.append(first + W.WINDOW - 1 + factor[hit])
    copies = jobs.records_of(got.get(W.COPIES, []), W.RUN)
    if len(copies):
        doc.append(copies["doc"])
        start.append(copies["start"].astype(np.int64))
        end.append(copies["next"].astype(np.int64) + W.WINDOW - 1)
    if doc:
        yield W.span_batch(*A.merge_spans(*(np.concatenate(x) for x in (doc, start, end))))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end): token spans that are later copies."""
    buckets = jobs.parts_for(docs)
    return jobs.exchange(W.texts_of(docs, id_col, text_col), W.send(buckets), buckets, receive, W.SPANS)


def dedup_suffixes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "removed_tokens"
) -> DataFrame:
    """Documents without later copies of passages of 50 tokens or more.

    Returns the input's columns with the text cut, and ``removed_tokens``. The earliest copy by
    (doc_id, position) stays, so it does not matter how the table is split. Tokens are split at ASCII
    white space and compared as they stand. Null ids and null, empty or shorter texts are returned as they are
    with 0. Documents that consist of copies alone are dropped. Rows that repeat a doc_id are one
    document: what is equal at the same place isn't a copy, and cuts, by token places, hold for all of them, also where
    their texts differ. An empty table gives an empty one; an input column named ``removed_tokens`` is replaced, other extra columns are kept.
    """
    with jobs.Scratch(docs.sparkSession) as tmp:
        tasks = jobs.tasks_for(docs, jobs.parts_for(docs))
        spans = tmp.keep(W.by_document(repeated_spans(docs, id_col, text_col), tasks))
    return W.remove_spans(docs, spans, id_col, text_col, removed_col)
