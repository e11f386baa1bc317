"""Operator 5: benchmark passages found by a generalised suffix automaton.

The automaton holds every substring of the normalised test items (NFKD, lower case, words of letters, marks and
digits; Han, Hiragana and Katakana one by one). A document's words stream through it; after each word the state
knows the longest suffix read so far that occurs in some item. A match of ``max_length`` words is cut. An item is
covered by the ``piece``-word stretches of it that the document has anywhere: they are the ends of suffix-link
chains, so each item is credited, whatever longer match of another item it lies in. Where ``max_coverage`` of an item
is covered, all its stretches are cut. Items don't influence each other.

Streaming starts only where a ``piece``-word gram of the items occurs, found by hash for a whole
slice of texts at once; no match of ``piece`` words can lie elsewhere, so nothing is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skeinlake.llm import arrays as A
from skeinlake.llm import jobs, windows as W

#: Words of test items in one automaton (about 300 bytes each in a worker, 8 in its broadcast); more make more automata,
#: streamed over the documents one after another. An item is in one of them, so results don't depend on it.
SHARD_WORDS = 200_000
#: Items credited at once while coverage is counted.
_CREDITS = 1 << 21


class SuffixAutomaton:
    """Suffix automaton of several token rows."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def add(self, tokens: list[int]) -> list[int]:
        """Add a row; the states of its prefixes."""
        last = 0
        prefixes = []
        for t in tokens:
            q = self.next[last].get(t)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, t)
            else:
                new = self._state(self.length[last] + 1, {}, -1)
                p = last
                while p != -1 and t not in self.next[p]:
                    self.next[p][t] = new
                    p = self.link[p]
                if p == -1:
                    self.link[new] = 0
                else:
                    q = self.next[p][t]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, t)
                last = new
            prefixes.append(last)
        return prefixes

    def anchors(self, piece: int) -> np.ndarray:
        """For each state, the one on its chain of suffix links that has its suffix of ``piece`` tokens; -1 for shorter states."""
        out = np.full(len(self.length), -1, np.int64)
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            if self.length[v] >= piece:
                out[v] = v if self.length[self.link[v]] < piece else out[self.link[v]]
        return out

    def stream(self, tokens: list[int]) -> tuple[list[int], list[int]]:
        """After each token the state, and the length of the longest match that ends there."""
        states, lengths = [], []
        v = n = 0
        edges, link, length = self.next, self.link, self.length
        for t in tokens:
            while v and t not in edges[v]:
                v = link[v]
                n = length[v]
            to = edges[v].get(t)
            if to is None:
                v = n = 0
            else:
                v = to
                n += 1
            states.append(v)
            lengths.append(n)
        return states, lengths


class Index:
    """An automaton over item tokens with what a scan needs before and after it."""

    def __init__(self, items: list[np.ndarray], piece: int):
        self.piece = piece
        items = [x for x in items if len(x) >= piece]
        self.sizes = np.array([len(x) for x in items], np.int64)
        self.words = np.unique(np.concatenate(items)) if items else np.zeros(0, np.uint64)
        self.automaton = SuffixAutomaton()
        grams: list[np.ndarray] = []
        state, item, stop = [], [], []
        for i, x in enumerate(items):
            prefixes = self.automaton.add(np.searchsorted(self.words, x).tolist())
            state += prefixes[piece - 1 :]
            item += [i] * (len(x) - piece + 1)
            stop += range(piece, len(x) + 1)
            at = np.arange(len(x) - piece + 1)
            grams.append(A.span_hash(A.prefix(x), at, at + piece))
        self.anchor = self.automaton.anchors(piece)
        of = self.anchor[state] if state else np.zeros(0, np.int64)
        order = np.argsort(of, kind="stable")
        self.item, self.stop = np.array(item, np.int64)[order], np.array(stop, np.int64)[order]
        self.first = np.searchsorted(of[order], np.arange(len(self.anchor) + 1))
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.grams >> A.U64(44)] = True

    def regions(self, tok: A.Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first token, end token) of stretches in which each gram of ``piece`` tokens is an item's."""
        n, k = len(tok.hash), self.piece
        none = np.zeros(0, np.int64)
        if n < k or not len(self.grams):
            return none, none, none
        at = np.arange(n - k + 1)
        h = A.span_hash(A.prefix(tok.hash), at, at + k)
        at = np.flatnonzero(self.bits[h >> A.U64(44)])
        h = h[at]
        at = at[self.grams[np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)] == h]
        row = np.searchsorted(tok.first, at, "right") - 1
        inside = at + k <= tok.first[row + 1]
        at, row = at[inside], row[inside]
        if not len(at):
            return none, none, none
        new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(row) > 0)])
        begin = np.flatnonzero(new)
        final = np.append(begin[1:], len(at)) - 1
        return row[begin], at[begin], at[final] + k

    def spans(self, tok: A.Tokens, max_length: int, max_coverage: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end) to cut, in tokens of the row."""
        row, start, end = self.regions(tok)
        if not len(row):
            return row, start, end
        states: list[int] = []
        lengths: list[int] = []
        for a, b in zip(start.tolist(), end.tolist()):
            v, n = self.automaton.stream(np.searchsorted(self.words, tok.hash[a:b]).tolist())
            states += v
            lengths += n
        place = A.ragged(start, end - start)
        of_row = np.repeat(row, end - start)
        length = np.array(lengths, np.int64)
        within = np.flatnonzero(length >= self.piece)
        place, of_row, length, anchor = place[within], of_row[within], length[within], self.anchor[states][within]
        pairs, which = np.unique(np.stack([of_row, anchor]), axis=1, return_inverse=True)
        leaked = self.leaked(pairs[0], pairs[1], max_coverage)[which.ravel()]
        reach = np.where(length >= max_length, length, np.where(leaked, self.piece, 0))
        cut = np.flatnonzero(reach)
        base = tok.first[of_row[cut]]
        return of_row[cut], place[cut] + 1 - reach[cut] - base, place[cut] + 1 - base

    def leaked(self, row: np.ndarray, anchor: np.ndarray, max_coverage: float) -> np.ndarray:
        """Which of the distinct (row, anchor), sorted by row, belong to an item that the row covers."""
        out = np.zeros(len(row), bool)
        count = self.first[anchor + 1] - self.first[anchor]
        at, size = A.runs_of(row)
        credits = np.cumsum(np.add.reduceat(count, at)) // _CREDITS
        for block in np.unique(credits):
            rows = np.flatnonzero(credits == block)
            i = np.arange(at[rows[0]], at[rows[-1]] + size[rows[-1]])
            of = np.repeat(i, count[i])
            entry = A.ragged(self.first[anchor[i]], count[i])
            item, stop = self.item[entry], self.stop[entry]
            order = np.lexsort((stop, item, row[of]))
            r, x, s = row[of][order], item[order], stop[order]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
            gain = np.full(len(r), self.piece)
            gain[1:] = np.where(new[1:], self.piece, np.minimum(self.piece, s[1:] - s[:-1]))
            begin = np.flatnonzero(new)
            covered = np.add.reduceat(gain, begin)
            full = covered >= max_coverage * self.sizes[x[begin]] - 1e-9
            hit = np.empty(len(r), bool)
            hit[order] = np.repeat(full, np.diff(np.append(begin, len(r))))
            out[of[hit]] = True
        return out


def item_words(benchmark: DataFrame, text_col: str) -> DataFrame:
    """(words, n, shard key) of each distinct text of the items: its word hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in A.normal_slices(batch.column(0)):
                tok = A.Tokens(texts, A.WORDS)
                rows = [tok.hash[a:b] for a, b in zip(tok.first[:-1], tok.first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in rows], pa.binary()), pa.array([len(x) for x in rows], pa.int64())], names=["words", "n"])

    texts = benchmark.select(F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    return texts.mapInArrow(run, "words binary, n bigint").where("n > 0").distinct()


_built: dict[str, Index] = {}


def _index(name: str, items: list[np.ndarray], piece: int) -> Index:
    """The index of a broadcast, built once a worker; the one before it is let go."""
    if name not in _built:
        _built.clear()
        _built[name] = Index(items, piece)
    return _built[name]


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, max_length: int, max_coverage: float, piece: int, id_col: str, text_col: str, item_text_col: str, tmp: jobs.Scratch
) -> list[DataFrame]:
    """(doc_id, start, end) to cut, in words: one table for each shard of the items."""
    words = tmp.save(item_words(benchmark, item_text_col))
    shards = -(-(words.where(F.col("n") >= piece).agg(F.sum("n")).first()[0] or 0) // SHARD_WORDS)
    texts = W.texts_of(docs, id_col, text_col)
    out = []
    for shard in range(shards):
        mine = words.where((F.col("n") >= piece) & (F.pmod(F.xxhash64("words"), F.lit(shards)) == shard)).select("words").orderBy("words").toArrow()
        items = [np.frombuffer(x, np.uint64) for x in mine.column(0).to_pylist()]
        shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                index = _index(name, shared.value, piece)
                doc = batch.column(0).to_numpy(zero_copy_only=False)
                for at, part in A.normal_slices(batch.column(1)):
                    row, start, end = index.spans(A.Tokens(part, A.WORDS), max_length, max_coverage)
                    if len(row):
                        yield W.span_batch(*A.merge_spans(doc[at + row], start, end))

        out.append(tmp.save(texts.mapInArrow(scan, W.SPANS)))
        shared.destroy()
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    max_length: int = 13,
    max_coverage: float = 0.6,
    piece: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_text_col: str = "text",
    removed_col: str = "removed_tokens",
) -> DataFrame:
    """Documents without passages of test items.

    Returns the input's columns with the text cut, and ``removed_tokens``, in words. Items of fewer than ``piece`` words
    can't be told from ordinary phrases and match nothing; null items likewise. Repeated items
    count once. Null ids and null or empty texts are returned as they are with 0. A document of which nothing is left
    is dropped. Rows that repeat a doc_id share their cuts. Empty tables of documents or items are
    allowed; an input column named ``removed_tokens`` is replaced, other extra columns are kept. Where normalisation
    makes several words of one character, cuts end at whole characters.
    """
    with jobs.Scratch(docs.sparkSession) as tmp:
        found = contaminated_spans(docs, benchmark, max_length, max_coverage, piece, id_col, text_col, item_text_col, tmp)
        spans = docs.sparkSession.createDataFrame([], W.SPANS)
        for more in found:
            spans = spans.unionByName(more)
        spans = tmp.keep(W.by_document(spans, jobs.tasks_for(docs, jobs.parts_for(docs))))
    return W.remove_spans(docs, spans, id_col, text_col, removed_col, A.WORDS)
