import random
import re

import numpy as np
from pyspark.sql import functions as F

from skeinlake.llm import components, jobs, setsketch as S


def shingles(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))) if w else frozenset()


def brute(rows, threshold):
    """Documents kept, by all pairs."""
    sets = {i: shingles(t) for i, t in rows if i is not None and shingles(t)}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i for i, t in rows if i not in up or root(i) == i}


def test_like_all_pairs(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = S.dedup_near(docs).collect()
    assert {r.doc_id for r in got} == brute(rows, 0.55)
    assert sum(r.doc_id == 7 for r in got) == 2
    copies = {r.doc_id: r.near_copies for r in got}
    assert copies[5] == 1 and copies[0] == 0 and copies[25] == 0
    assert S.dedup_near(docs.limit(0)).count() == 0


def test_recall_against_all_pairs(spark):
    r = random.Random(11)
    rows, pairs = [], []
    for g in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(30, 200))]
        first = len(rows)
        for _ in range(r.randrange(1, 5)):
            t = [x if r.random() > 0.06 else f"n{r.randrange(10**6)}" for x in base]
            rows.append((len(rows), " ".join(t)))
        pairs += [(a, b) for a in range(first, len(rows)) for b in range(a + 1, len(rows))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {x.doc_id for x in S.dedup_near(df).collect()}
    want = brute(rows, 0.55)
    dropped = {i for i, _ in rows} - want
    assert len(dropped - kept) >= 0.9 * len(dropped)
    assert want <= kept  # a document that all pairs keep is never dropped


def test_chain_whose_middle_is_not_the_smallest(spark):
    """b is like a and like c, a isn't like c: all meet in one group."""
    w = [f"t{i}" for i in range(120)]
    rows = [(5, " ".join(w[:90])), (9, " ".join(w[15:105])), (7, " ".join(w[30:120]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {x.doc_id for x in S.dedup_near(df).collect()} == brute(rows, 0.55) == {5}


def test_registers_merge_and_estimate():
    r = np.random.default_rng(3)
    errors = []
    for j in (0.2, 0.5, 0.8):
        for _ in range(30):
            n = 400
            both = int(2 * n * j / (1 + j))
            x = r.integers(0, 2**63, 2 * n - both, dtype=np.int64).astype(np.uint64)
            u, v = S.minima(x[:n]), S.minima(x[n - both :])
            assert (S.registers_of(np.minimum(u, v)) == np.maximum(S.registers_of(u), S.registers_of(v))).all()
            errors.append(S.joint_jaccard(S.registers_of(u)[None], S.registers_of(v)[None])[0] - j)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05
    sizes = [S.cardinality(S.registers_of(S.minima(r.integers(0, 2**63, 1000, dtype=np.int64).astype(np.uint64)))[None])[0] for _ in range(40)]
    assert abs(np.mean(sizes) - 1000) < 60


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 4), (4, 9), (8, 4), (20, 21)] + [(i, i + 1) for i in range(100, 160)]
    with jobs.Scratch(spark) as tmp:
        got = components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), tmp).collect()
    want = {1: 1, 2: 1, 3: 1, 9: 4, 4: 4, 8: 4, 20: 20, 21: 20} | {i: 100 for i in range(100, 161)}
    assert sorted((r.doc_id, r.keeper) for r in got) == sorted(want.items())


def test_hot_bucket_with_an_unlike_center(spark, monkeypatch):
    """One bucket of all: the smallest member is like nobody, the others are two chains and loners. No link is lost."""
    monkeypatch.setattr(S, "bands", lambda sketches: sketches.select(F.lit(7).cast("bigint").alias("bucket"), "doc_id"))
    w = [f"t{i}" for i in range(4000)]
    rows = [(0, " ".join(f"other{i}" for i in range(60)))]
    for base in (0, 2000):
        rows += [(base + k + 1, " ".join(w[base + 8 * k : base + 8 * k + 80])) for k in range(60)]  # each is like its neighbours only
    rows += [(5000 + k, " ".join(f"u{k}x{i}" for i in range(40))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id for x in S.dedup_near(df).collect()}
    assert got == brute(rows, 0.55) == {0, 1, 2001, *range(5000, 5020)}
