import random

import numpy as np
import pyarrow as pa
import pytest

from skeinlake.llm import arrays as A, jobs, quality as Q


def ordinary(r, n):
    out = []
    for i in range(n):
        w = "".join(r.choices(["an", "ti", "er", "ha", "sto", "we"], k=r.randrange(1, 4)))
        out.append(w.capitalize() if i % 9 == 0 else w + (random.Random(i).choice([".", ",", "", "", ""])))
    return " ".join(out)


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(5)
    rows = [(i, ordinary(r, r.randrange(20, 300)), "en", f"s{i % 3}") for i in range(400)]
    rows += [(1000 + i, " ".join(w + "%%%" for w in ordinary(r, 80).split()), "en", "s0") for i in range(15)]
    rows += [(1100 + i, ordinary(r, 60).upper(), "en", "s1") for i in range(15)]
    rows += [(1200 + i, "same words again " * 40, "en", "s2") for i in range(15)]
    rows += [(2000, None, "en", "s0"), (2001, "", "en", "s0"), (2002, " \n", None, None), (2003, "x", "en", "s1"), (2004, ordinary(r, 40000), "en", "s2"), (None, "%%% " * 50, "en", "s0")]
    rows += [(2100 + i, ordinary(r, 100), "fr", f"tiny{i}") for i in range(5)] + [rows[3]]
    return spark.createDataFrame([(*x, 4, "y") for x in rows], "doc_id bigint, text string, lang string, source string, n int, g string").repartition(4)


def test_filter(table):
    got = Q.filter_quality(table)
    assert got.columns == table.columns
    ids = [r.doc_id for r in got.collect()]
    kept = set(ids)
    assert sum(i in kept for i in range(400)) >= 396 and ids.count(3) == 2
    assert not [i for i in kept if i is not None and 1000 <= i < 1300]
    assert {2000, 2001, 2002, 2003, 2004, None} <= kept
    assert {2100 + i for i in range(5)} <= kept  # groups of one, judged by all
    assert Q.filter_quality(table.limit(0)).count() == 0


def plain_statistics(text):
    w = [x for x in text.replace("\n", " ").split(" ") if x]
    raw = "".join(w).encode()
    share = lambda c, m: np.arcsin(np.sqrt(min(1, c / max(m, 1))))
    again = sum(any(w[j] == w[i] for j in range(max(0, i - Q.NEAR), i)) for i in range(len(w)))
    symbols = sum(32 < b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:?'\"()-" for b in raw)
    letters = sum(chr(b).isascii() and chr(b).isalpha() or b >= 0xC0 for b in raw)
    return [share(symbols, len(raw)), share(sum(65 <= b <= 90 for b in raw), letters), share(again, len(w)), np.log(max(len(raw), 1) / max(len(w), 1)), share(sum(len(x.encode()) <= 3 for x in w), len(w))]


def test_statistics():
    texts = ["Hello World! a b a", "ÄÖ é %% !! ab", "one", "", "A a A a " * 40, "x\ny x"]
    n, got = Q.statistics(A.as_strings(pa.array(texts)))
    assert n.tolist() == [len(t.split()) for t in texts]
    for t, row in zip(texts, got):
        assert np.allclose(row, plain_statistics(t) if t else 0)


def concentrate(x, pick, subset):
    """Plain concentration steps from a subset: the log determinant, mean and precision they end with."""
    last = np.inf
    while True:
        mean, cov = x[pick].mean(axis=0), np.cov(x[pick].T, bias=True) + np.diag(Q.FLOOR**2)
        det = np.linalg.slogdet(cov)[1]
        if len(pick) > 8:
            if det >= last - 1e-3:
                return last, mean, np.linalg.inv(cov)
            last = det
        d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
        pick = np.argsort(d)[: int(np.ceil(subset * len(x)))]


def test_least_determinant(spark):
    """As low as the best of many random starts, also where a third of a group is junk of one kind or two."""
    r = np.random.default_rng(4)
    tables = {}
    for g, junk in (("clean", 0), ("third", 130), ("two", 100)):
        mix = r.normal(size=(Q.D, Q.D)) * 0.3
        x = r.normal(size=(400, Q.D)) @ mix
        x[:junk] = r.normal(size=(junk, Q.D)) * 0.1 + 3
        if g == "two":
            x[100:140] = r.normal(size=(40, Q.D)) * 0.1 - 4
        tables[g] = x
    rows = spark.createDataFrame([(g, *map(float, v)) for g, x in tables.items() for v in x], "g string, " + ", ".join(f"x{j} double" for j in range(Q.D)))
    with jobs.Scratch(spark) as tmp:
        start = []
        for g, x in tables.items():
            m = np.median(x, axis=0)
            s = np.sqrt((1.4826 * np.median(np.abs(x - m), axis=0)) ** 2 + Q.FLOOR**2)
            z = (x - m) / s
            t, u = np.tanh(z), z / np.linalg.norm(z, axis=1, keepdims=True)
            start.append((g, *map(float, m), *map(float, s), *(float((k[:, i] * k[:, j]).mean()) for k in (t, u) for i, j in Q.PAIRS)))
        names = ["g", *(f"c{k}" for k in range(len(start[0]) - 1))]
        params = spark.createDataFrame(start, names).mapInArrow(Q._starts, Q.PARAMS)
        assert params.count() == 9
        fit = {f.g: f for f in Q.concentrated(rows, params, 0.6, tmp).collect()}
    for g, x in tables.items():
        tries = [concentrate(x, r.choice(len(x), 8, replace=False), 0.6) for _ in range(60)]
        best = min(tries, key=lambda f: f[0])
        assert abs(fit[g].det - best[0]) < 0.35, (g, fit[g].det, best[0])
        assert np.allclose(fit[g].mean, best[1], atol=0.15)
    x = tables["third"] - np.array(fit["third"].mean)
    d = np.einsum("ni,ij,nj->n", x, np.array(fit["third"].prec).reshape(Q.D, Q.D), x)
    assert d[:130].min() > d[130:].max()


def test_same_at_every_size(spark, table):
    """A group's distances don't jump as it grows past any number of texts."""
    r = random.Random(3)
    base = [(i, ordinary(r, r.randrange(60, 200)), "en", "big") for i in range(200)]
    small = [(1000 + i, ordinary(r, r.randrange(60, 200)), "en", "small") for i in range(60)]
    seen = []
    for n in (45, 52, 60):
        df = spark.createDataFrame(base + small[:n], "doc_id bigint, text string, lang string, source string")
        with jobs.Scratch(spark) as tmp:
            seen.append({x.doc_id: x.d2 for x in Q.distances(df, "doc_id", "text", ["lang", "source"], 0.6, 50, tmp).collect()})
    change = [abs(seen[1][1000 + i] - seen[0][1000 + i]) / (1 + seen[0][1000 + i]) for i in range(45)]
    assert np.median(change) < 0.35 and max(seen[0].values()) < 45
