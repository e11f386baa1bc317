"""Operators 3 and 10 against a dictionary of all 50-token windows."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from skeinlake.llm import arrays as A
from skeinlake.llm import doubling_dedup, jobs, suffix_dedup

SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")


def tokens(text):
    return [x for x in SPACE.split(text or "") if x]


def brute(rows, window=50):
    """(doc_id, text) to the tokens left, by doc_id."""
    rows = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    first = {}
    for i, t in rows:
        w = tokens(t)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, (i, j)), (i, j))
    left = {}
    for i, t in rows:
        w = tokens(t)
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < (i, j):
                gone.update(range(j, j + window))
        left[i] = [x for k, x in enumerate(w) if k not in gone]
    return left


@pytest.mark.parametrize("op", [suffix_dedup.dedup_suffixes, doubling_dedup.dedup_doubling])
def test_like_brute_force(docs, op):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    left = brute(rows)
    got = op(docs)
    assert [c for c in got.columns if c != "longest_repeat"] == docs.drop("removed_tokens").columns + ["removed_tokens"]
    result = got.collect()
    texts = {r.doc_id: r.text for r in result if r.doc_id is not None}
    for i, t in {(i, t) for i, t in rows if i is not None}:
        if t is None or not tokens(t):
            assert texts[i] == t
        elif left[i]:
            assert tokens(texts[i]) == left[i]
        else:
            assert i not in texts
    assert sum(r.doc_id == 7 for r in result) == 2  # repeated rows are one document
    assert [r.text for r in result if r.doc_id is None] == [t for i, t in rows if i is None]
    assert 20 not in texts and texts[3] == dict(rows)[3]
    assert len(tokens(texts[23])) == 25
    assert all(r.removed_tokens >= 0 and r.start == 1 and r.part == "x" for r in result)


@pytest.mark.parametrize("op", [suffix_dedup.dedup_suffixes, doubling_dedup.dedup_doubling])
def test_empty_table(docs, op):
    assert op(docs.limit(0)).count() == 0


def longest(rows):
    """The greatest of 50, 100, 200, ... tokens of which each text has a repeated window."""
    out = {}
    size = 50
    rows = sorted({(i, tuple(tokens(t))) for i, t in rows if i is not None and t is not None})
    while True:
        seen = {}
        for i, w in rows:
            for j in range(len(w) - size + 1):
                seen.setdefault(w[j : j + size], set()).add((i, j))
        again = {i for places in seen.values() if len(places) > 1 for i, _ in places}
        if not again:
            return out
        out |= dict.fromkeys(again, size)
        size *= 2


def test_longest_repeat(docs):
    got = {r.doc_id: r.longest_repeat for r in doubling_dedup.dedup_doubling(docs).collect() if r.doc_id is not None}
    want = longest([(r.doc_id, r.text) for r in docs.collect()])
    assert {i: n for i, n in got.items() if n is not None} == {i: n for i, n in want.items() if i in got}
    assert 3 in want and 30 in want and 0 not in want


@pytest.mark.parametrize("per", [1, 40])
def test_many_buckets_in_a_partition(spark, monkeypatch, per):
    """Shared passages of all lengths up to 900 tokens; buckets that share partitions make no difference."""
    monkeypatch.setattr(jobs, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(jobs, "PART_BYTES", 2000 * per)
    r = random.Random(1)
    made = [[f"t{r.randrange(10**6)}" for _ in range(n)] for n in (49, 50, 63, 99, 100, 101, 160, 399, 400, 900)]
    rows = []
    for i in range(60):
        t = [f"u{r.randrange(10**6)}" for _ in range(r.randrange(0, 120))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(t) + 1)
            t[at:at] = r.choice(made)
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = brute(rows)
    for op in (suffix_dedup.dedup_suffixes, doubling_dedup.dedup_doubling):
        got = {x.doc_id: tokens(x.text) for x in op(df).collect()}
        assert all(got.get(i, []) == left[i] for i, t in rows if t)
    got = {x.doc_id: x.longest_repeat for x in doubling_dedup.dedup_doubling(df).collect()}
    want = longest(rows)
    assert got == {i: want.get(i) for i in got} and max(want.values()) == 800


def test_rows_of_one_id_with_different_texts(spark):
    """They are one document whichever comes first: its cuts hold for both."""
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(1, shared), (2, f"a {shared} b"), (2, "c d"), (2, f"a {shared} b")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id bigint, text string")
        got = [sorted((r.doc_id, r.text) for r in op(df).collect()) for op in (suffix_dedup.dedup_suffixes, doubling_dedup.dedup_doubling)]
        assert got == [[(1, shared), (2, "a b"), (2, "a b"), (2, "c ")]] * 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=14), min_size=1, max_size=4))
def test_previous_factors(texts):
    """Longest previous factor by definition: the longest prefix that also starts at an earlier place."""
    flat = [x for t in texts for x in t]
    left = [len(t) - k for t in texts for k in range(len(t))]
    got = suffix_dedup.previous_factors(np.array(flat, np.uint64), np.array(left))

    def common(i, j):
        n = 0
        while n < min(left[i], left[j]) and flat[i + n] == flat[j + n]:
            n += 1
        return n

    assert got.tolist() == [max([common(i, j) for j in range(i)], default=0) for i in range(len(flat))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30), st.integers(1, 9)), min_size=1, max_size=20))
def test_merge_spans(spans):
    row, start, size = (np.array(x, np.int64) for x in zip(*spans))
    got = A.merge_spans(row, start, start + size)
    covered = {(r, x) for r, s, n in spans for x in range(s, s + n)}
    again = [(r, x) for r, s, e in zip(*(g.tolist() for g in got)) for x in range(s, e)]
    assert sorted(again) == sorted(covered)
    assert all(r0 < r1 or e0 < s1 for (r0, _, e0), (r1, s1, _) in zip(zip(*got), list(zip(*got))[1:]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té漢", max_size=20), max_size=6))
def test_tokens(texts):
    import pyarrow as pa

    tok = A.Tokens(A.as_strings(pa.array(texts, pa.string())))
    raw = bytes(tok.data)
    got = [[raw[s:e].decode() for s, e in zip(tok.start[a:b], tok.end[a:b])] for a, b in zip(tok.first[:-1], tok.first[1:])]
    assert got == [tokens(t) for t in texts]
    by_hash = {}
    for w, h in zip([w for t in got for w in t], tok.hash.tolist()):
        assert by_hash.setdefault(w, h) == h
    assert len(set(by_hash.values())) == len(by_hash)
