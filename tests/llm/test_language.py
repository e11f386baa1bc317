import math
import random
from collections import defaultdict

import numpy as np
import pytest

from skeinlake.llm import jobs, language as L

SYLLABLES = {"aa": ["ka", "to", "mi", "ra", "ne", "su"], "bb": ["schl", "ung", "ein", "ter", "ach"], "cc": ["éau", "oi", "çon", "tre", "ment"]}


def sentence(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randrange(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(2)
    rows = [(i, sentence(r, lang := r.choice(list(SYLLABLES)), r.randrange(5, 40)), lang) for i in range(300)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "  \n ", None), (1003, "+=+=/// 0101 <<>> 0110 {}{} @@@ ### 998877 %%%%", None), (None, sentence(r, "bb", 20), "bb"), (5, sentence(r, "cc", 20), None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


class Plain:
    """Interpolated Kneser-Ney by dictionaries, for one language."""

    def __init__(self, texts, letters):
        top = defaultdict(int)
        for t in texts:
            s = chr(L.BOS) * (L.ORDER - 1) + t
            for i in range(L.ORDER - 1, len(s)):
                top[s[i - L.ORDER + 1 : i + 1]] += 1
        self.counts = {L.ORDER: top}
        for n in range(L.ORDER - 1, 0, -1):
            low = defaultdict(int)
            for g in self.counts[n + 1]:
                low[g[1:]] += 1
            self.counts[n] = low
        self.d, self.total, self.kinds = {}, {}, {}
        for n, c in self.counts.items():
            one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            self.d[n] = one / (one + 2 * two) if one and two else 0.5
            self.total[n], self.kinds[n] = defaultdict(int), defaultdict(int)
            for g, v in c.items():
                self.total[n][g[:-1]] += v
                self.kinds[n][g[:-1]] += 1
        self.letters = letters

    def p(self, g):
        n = len(g)
        if n == 0:
            return 1 / (self.letters + 1)
        ctx = g[:-1]
        if not self.total[n][ctx]:
            return self.p(g[1:])
        lam = self.d[n] * self.kinds[n][ctx] / self.total[n][ctx]
        return max(self.counts[n].get(g, 0) - self.d[n], 0) / self.total[n][ctx] + lam * self.p(g[1:])


def test_scores_like_dictionaries(spark, table):
    langs, model = L.train(table)
    assert langs == ["aa", "bb", "cc"]
    rows = [(r.text, r.lang) for r in table.collect() if r.text and r.text.strip() and r.lang]
    norm = lambda t: " ".join(t.lower().split())
    letters = len({c for t, _ in rows for c in norm(t)})
    plain = [Plain([norm(t) for t, g in rows if g == x], letters) for x in langs]
    texts = [norm(rows[0][0]), "kato zzqx éau!", "neu"]
    import pyarrow as pa

    code, first = L.characters(pa.array(texts, pa.large_string()))
    place, n = L.real_places(first)
    got = np.split(model.score(L.keys_of(code)[place]), np.cumsum(n)[:-1])
    for t, rows_ in zip(texts, got):
        s = chr(L.BOS) * (L.ORDER - 1) + t
        want = [[math.log(m.p(s[i : i + L.ORDER])) for m in plain] for i in range(len(t))]
        assert np.allclose(rows_, want, atol=1e-4)


def test_probabilities_sum_to_one(spark, table):
    _, model = L.train(table)
    alphabet = sorted({k & 0xFFFF for k in L_keys(model)})
    for ctx in ("kat", "zzz", "\2\2\2"):
        keys = np.array([(ord(ctx[0]) << 48) | (ord(ctx[1]) << 32) | (ord(ctx[2]) << 16) | c for c in alphabet], np.uint64)
        total = np.exp(model.score(keys).astype(float)).sum(axis=0)
        unseen = 1 / (len(alphabet) + 1)
        assert (total <= 1 + 1e-3).all() and (total >= 1 - unseen - 1e-3).all()


def L_keys(model):
    """Single characters of the model, back out of the bijective mix by trying all of the range."""
    rows, _ = model.logp[1]
    tried = np.arange(0x10000, dtype=np.uint64)
    return tried[rows.find(tried) >= 0].tolist()


def test_identify(table):
    got = L.identify_language(table).collect()
    rows = table.collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    true = {r.doc_id: r.lang for r in rows if r.doc_id is not None and r.doc_id < 300 and r.lang}
    right = sum(any(g.language == lang for g in by_id[i]) for i, lang in true.items())
    assert right >= 0.98 * len(true)
    for i in (1000, 1001, 1002):
        assert by_id[i][0].language == "und" and by_id[i][0].cross_entropy is None
    assert by_id[1003][0].language == "und"
    assert "cc" in {g.language for g in by_id[5]}
    assert by_id[None][0].language == "bb"


def test_held_out_accuracy(spark, table):
    r = random.Random(99)
    fresh = [(i, sentence(r, lang := r.choice(list(SYLLABLES)), 8), lang) for i in range(150)]
    langs, model = L.train(table)
    with jobs.Scratch(spark) as tmp:
        got = L.scored(spark.createDataFrame(fresh, "doc_id bigint, text string, lang string"), iter([model]), False, "doc_id", "text", tmp).collect()
    assert sum(langs[g.best] == dict((i, x) for i, _, x in fresh)[g.doc_id] for g in got) >= 147


def test_empty_and_unlabelled(spark, table):
    assert L.identify_language(table.limit(0)).count() == 0
    only = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert [(r.doc_id, r.language) for r in L.identify_language(only).collect()] == [(1, "und")]


def test_hash_array():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 2**63, 5000, dtype=np.int64).astype(np.uint64))
    h = L.HashArray(keys)
    at = h.find(keys)
    assert (h.order[at] == np.arange(len(keys))).all()
    assert (h.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert (L.HashArray(keys[:0]).find(keys[:3]) == -1).all()


def test_no_ngram_is_dropped(spark):
    """However many n-grams there are, the model has all of them, the rare ones of a small language too."""
    r = random.Random(4)
    rows = [(i, sentence(r, "aa", 30), "aa") for i in range(60)] + [(100 + i, f"{sentence(r, 'bb', 3)} x{i}q", "bb") for i in range(3)]
    langs, model = L.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    norm = lambda t: chr(L.BOS) * (L.ORDER - 1) + " ".join(t.lower().split())
    grams = {s[i : i + L.ORDER] for _, t, _ in rows for s in [norm(t)] for i in range(len(s) - L.ORDER + 1)}
    assert len(grams) > 300 and len(model.logp[L.ORDER][1]) == len(grams)
    plain = [Plain([norm(t)[L.ORDER - 1 :] for _, t, g in rows if g == x], len({g[-1] for g in grams})) for x in langs]
    grams = sorted(grams)
    key = np.array([sum(ord(c) << 16 * (L.ORDER - 1 - i) for i, c in enumerate(g)) for g in grams], np.uint64)
    assert np.allclose(model.score(key), [[math.log(m.p(g)) for m in plain] for g in grams], atol=1e-4)


def test_shards_agree(table, monkeypatch):
    """A model in many shards gives what one gives."""
    key = lambda r: (r.doc_id is None, r.doc_id, r.cross_entropy or 0)
    whole = sorted(L.identify_language(table).collect(), key=key)
    monkeypatch.setattr(L, "SHARD_NGRAMS", 400)
    cut = sorted(L.identify_language(table).collect(), key=key)
    assert [(r.doc_id, r.language, r.best_language) for r in cut] == [(r.doc_id, r.language, r.best_language) for r in whole]
    assert np.allclose([r.cross_entropy or 0 for r in cut], [r.cross_entropy or 0 for r in whole], atol=1e-5)


def test_long_texts_clashing_columns_and_rare_scripts(spark):
    r = random.Random(7)
    rows = [(i, sentence(r, g, 12), g, 1, 2) for i in range(60) for g in ("aa", "bb")]
    rows += [(900, sentence(r, "aa", 60000), "aa", 1, 2), (901, "\U0001d4d0\U0001d4d1" * 30, None, 1, 2), (902, "\U00020000\U00020001" * 30, None, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n int, best int")
    got = {x.doc_id: x.language for x in L.identify_language(df).collect()}
    assert got[900] == "aa" and got[901] == got[902] == "und"
    import pyarrow as pa

    code, _ = L.characters(pa.array(["\U0001d4d0\U00020000\ue000"], pa.large_string()))
    assert len(set(code[L.ORDER - 1 :].tolist())) == 3
