import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from skeinlake.llm import arrays as A, decontaminate as D


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def test_planted_passage(docs, benchmark):
    before = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in D.decontaminate(docs, benchmark).collect()}
    assert set(got) == set(before)
    hit = got.pop(24)
    assert hit.removed_tokens == 17 and "BENCHMARK" not in hit.text
    assert words(hit.text) == words(before[24].replace("THE QUICK BENCHMARK QUESTION ASKS WHICH METAL MELTS AT THE LOWEST TEMPERATURE OF ALL KNOWN ELEMENTS TODAY", ""))
    assert all(r.text == before[i] and r.removed_tokens == 0 for i, r in got.items())


def test_empty_tables(docs, benchmark):
    assert D.decontaminate(docs.limit(0), benchmark).count() == 0
    assert D.decontaminate(docs, benchmark.limit(0)).where("removed_tokens > 0").count() == 0


def brute(text, items, max_length, max_coverage, piece):
    """Words left: by the longest match that ends at each word, and by what each item alone has in common with the text."""
    w = words(text)
    gone = set()
    items = [x for x in {tuple(words(t)) for t in items} if len(x) >= piece]
    factors = {x[a : a + n] for x in items for n in range(1, len(x) + 1) for a in range(len(x) - n + 1)}
    for e in range(1, len(w) + 1):
        for n in range(e, max_length - 1, -1):
            if tuple(w[e - n : e]) in factors:
                gone.update(range(e - n, e))
                break
    grams = {tuple(w[k : k + piece]): None for k in range(len(w) - piece + 1)}
    for x in items:
        covered = {k + j for k in range(len(x) - piece + 1) if x[k : k + piece] in grams for j in range(piece)}
        if 10 * len(covered) >= round(10 * max_coverage) * len(x):
            own = {x[k : k + piece] for k in range(len(x) - piece + 1)}
            gone.update(k + j for k in range(len(w) - piece + 1) if tuple(w[k : k + piece]) in own for j in range(piece))
    return [x for k, x in enumerate(w) if k not in gone]


@pytest.mark.parametrize("shard", [10**6, 60])
def test_overlapping_items(spark, monkeypatch, shard):
    """Items that share pieces, one within another and in common templates, in automata of any size."""
    monkeypatch.setattr(D, "SHARD_WORDS", shard)
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(14)]
    items = [" ".join(r.choices(vocabulary, k=r.randrange(3, 30))) for i in range(8)]
    template = " ".join(r.choices(vocabulary, k=6))
    items += [f"{template} {' '.join(r.choices(vocabulary, k=5))}" for _ in range(6)]
    items += [" ".join(items[k].split()[2:11]) for k in range(4)]
    texts = []
    for d in range(80):
        t = r.choices(vocabulary, k=40)
        source = r.choice(items).split()
        t[10:10] = source[: r.randrange(len(source) + 1)]
        texts.append((d, " ".join(t)))
    got = D.decontaminate(
        spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"),
        max_length=9, max_coverage=0.7, piece=4,
    )
    got = {x.doc_id: x.text.split() for x in got.collect()}
    for d, t in texts:
        assert got.get(d, []) == brute(t, items, 9, 0.7, 4)


def test_item_within_a_longer_match(spark):
    x = [f"x{i}" for i in range(8)]
    y = ["before", *x, *(f"y{i}" for i in range(30))]
    text = " ".join(["some", "words", "before", *x, "and", "more"])
    items = spark.createDataFrame([(1, " ".join(x)), (2, " ".join(y))], "item_id bigint, text string")
    got = D.decontaminate(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), items).collect()
    assert [r.text for r in got] == ["some words before and more"]


def test_scripts_and_signs(spark):
    """Curly quotes, dashes, full-width and composed letters, and scripts without spaces."""
    items = [(1, "Don\u2019t say \u201chello\u201d \u2014 say caf\u00e9 r\u00e9sum\u00e9 na\u00efve five times"), (2, "\u8fd9\u662f\u4e00\u4e2a\u6d4b\u8bd5\u95ee\u9898\u8bf7\u56de\u7b54")]
    texts = [
        (1, "Intro: don't say 'hello' - say cafe\u0301 re\u0301sume\u0301 nai\u0308ve FIVE times, end"),
        (2, "\u524d\u6587\u3002\u8fd9\u662f\u4e00\u4e2a\u6d4b\u8bd5\u95ee\u9898\uff0c\u8bf7\u56de\u7b54\u3002\u540e\u6587"),
        (3, "\u00bd cup, \uff24on\u2019t say hello say caf\u00e9 r\u00e9sum\u00e9 na\u00efve \uff46ive times \u2026 the end"),
        (4, "\u8fd9\u662f\u53e6\u4e00\u4e2a"),
    ]
    got = D.decontaminate(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {r.doc_id: (r.text, r.removed_tokens) for r in got.collect()}
    assert got[1] == ("Intro: end", 10)
    assert got[2] == ("\u524d\u6587\u3002\u540e\u6587", 11)
    assert got[3] == ("\u00bd cup, the end", 10)
    assert got[4] == (texts[3][1], 0)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \u00e9e\u0301\u00bd\ufb01\uff76\uff9e\u6f22\u1100\u1161\u2026.\u212b", max_size=12))
def test_word_places(text):
    """Places of normalised words cover whole characters, in order, and have all letters between them."""
    start, end = A.word_places(text)
    raw = text.encode()
    assert (start < end).all() and (start[1:] >= start[:-1]).all()
    for a, b in zip(start, end):
        raw[a:b].decode()
    tok = A.Tokens(A.normalised(pa.array([text])), A.WORDS)
    assert len(tok.start) == len(start)
    norm = [bytes(tok.data[a:b]).decode() for a, b in zip(tok.start, tok.end)]
    for a, b, w in zip(start, end, norm):
        assert w in A.normalised(pa.array([raw[a:b].decode()])).to_pylist()[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=10), max_size=4), st.lists(st.integers(0, 4), max_size=30), st.integers(2, 4))
def test_automaton(items, text, piece):
    sa = D.SuffixAutomaton()
    prefixes = [sa.add(x) for x in items]
    factors = {tuple(x[a:b]) for x in items for a in range(len(x)) for b in range(a + 1, len(x) + 1)}
    states, lengths = sa.stream(text)
    assert lengths == [max(n for n in range(e + 1) if n == 0 or tuple(text[e - n : e]) in factors) for e in range(1, len(text) + 1)]
    anchor = sa.anchors(piece)
    for e, (v, n) in enumerate(zip(states, lengths), 1):
        if n >= piece:
            where = {(i, k) for i, x in enumerate(items) for k in range(piece, len(x) + 1) if x[k - piece : k] == text[e - piece : e]}
            assert where == {(i, k) for i, p in enumerate(prefixes) for k in range(piece, len(p) + 1) if anchor[p[k - 1]] == anchor[v]}
