import itertools
import random
import time

import numpy as np
from hypothesis import given, settings, strategies as st

from skeinlake.llm import html_extract as H


def page(r, i):
    w = lambda n: " ".join(r.choices(["stone", "river,", "maple.", "cloud", "harbor"], k=n))
    title, paragraphs = w(5), [w(r.randrange(8, 40)) for _ in range(r.randrange(1, 5))]
    links = "".join(f'<li><a href="/{k}">{w(1)}{k}</a></li>' for k in range(5))
    html = (
        f"<html><head><title>{title}</title><script>var x='<p>no</p>'</script></head><body><nav class='menu'><ul>{links}</ul></nav><!-- c -->"
        f"<div class=ad>Buy now {i}</div><article><h1>{title}</h1>{''.join(f'<p>{p}' for p in paragraphs)}</article><footer>&copy; all rights {i}</footer>"
    )
    return html, "\n".join([title, *paragraphs])


def test_parser():
    p = H.Page("<div id=x CLASS='a b'>one &amp; <b>two</b><p>three<p>four<br/>five<ul><li>six<li>seven</ul><script>if (a<b) '</p>'</script>tail <unfinished")
    got = [(p.tag[p.parent[i]], t) for i, t in enumerate(p.text) if t is not None]
    assert got == [("div", "one & "), ("b", "two"), ("p", "three"), ("p", "four"), ("p", "five"), ("li", "six"), ("li", "seven"), ("div", "tail ")] or got[-1][1].startswith("tail")
    assert p.words[1] == "x a b"
    assert H.Page("").tag == ["#root"] and H.Page("<").text[-1] == "<"
    assert H.Page("</p></div>text").text[-1] == "text"


def brute(parent, own, pair, prior):
    n = len(parent)
    weight = np.zeros(2)
    marginal = np.zeros((n, 2))
    for states in itertools.product((0, 1), repeat=n):
        s = prior[states[0]] + sum(own[i][states[i]] for i in range(n)) + sum(pair[i][states[parent[i]], states[i]] for i in range(1, n))
        for i in range(n):
            marginal[i, states[i]] += np.exp(s)
    return marginal[:, 1] / marginal.sum(axis=1)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9))
def test_sum_product(seed, n):
    r = np.random.default_rng(seed)
    parent = np.array([-1, *(r.integers(0, i) for i in range(1, n))])
    depth = np.zeros(n, int)
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    own, pair, prior = r.normal(size=(n, 2)), r.normal(size=(n, 2, 2)), r.normal(size=2)
    assert np.allclose(H.sum_product(parent, depth, own, pair, prior), brute(parent, own, pair, prior))


def test_held_out_pages(spark):
    r = random.Random(8)
    made = [page(r, i) for i in range(120)]
    pages = spark.createDataFrame([(i, f"http://x.example/{i}?a=1", h) for i, (h, _) in enumerate(made[:60])], "page_id bigint, url string, html string")
    documents = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(made[:60])], "doc_id bigint, text string")
    model = H.train(pages, documents)
    trees = [H.Page(h) for h, _ in made[60:]]
    good = 0
    for t, m, (_, truth) in zip(trees, model.marginals(trees), made[60:]):
        good += H.extract(t, m)[0] == truth
    assert good >= 57
    fresh = [(1, None, made[70][0], 3), (2, "u", None, 3), (3, "u", "", 3), (None, "u", "<p>x", 3), (4, "u", "<div>" * 3000 + "deep", 3), (1, None, made[70][0], 3)]
    df = spark.createDataFrame(fresh, "page_id bigint, url string, html string, text_nodes int")
    got = H.extract_pages(df, model).collect()
    assert len(got) == 6 and sum(x.text == made[70][1] for x in got) == 2
    assert {x.page_id: x.text_nodes for x in got}[2] == 0
    assert H.extract_pages(df.limit(0), model).count() == 0
    plain = H.extract_pages(df.where("page_id = 4"), None).collect()
    assert plain[0].text == "deep"
    assert H.train(pages.limit(0), documents) is None and H.train(pages, documents.limit(0)) is None


def test_long_and_broken_pages():
    """Ten megabytes of each kind are read in time that grows with their length alone."""
    model = H.TreeModel()
    r = random.Random(1)
    for i in range(20):
        h, truth = page(r, i)
        p = H.Page(h)
        model.add(p, H.label_page(p, truth))
    model.finish()
    kinds = {
        "open": lambda n: "<a " * (n // 3), "quote": lambda n: "<a b='" + "x" * n, "wrong": lambda n: "<b>" * (n // 7) + "</i>" * (n // 7), "deep": lambda n: "<div>" * (n // 5),
        "less": lambda n: "<" * n, "comment": lambda n: "<!-- " * (n // 5), "scope": lambda n: "<p><div>" + "<span>" * (n // 10) + "<hr>" * (n // 10), "text": lambda n: "word &amp; " * (n // 11),
    }

    def took(source):
        began = time.process_time()
        p = H.Page(source)
        m = model.marginals([p])[0]
        H.extract(p, m)
        assert len(p.tag) == len(m) and not np.isnan(m).any()
        return time.process_time() - began

    for name, make in kinds.items():
        small, large = took(make(500_000)), took(make(2_000_000))
        assert large < 8 * small + 1, (name, small, large)


def test_depth_keeps_all_text(spark):
    source = "".join(f"<div>t{i}" for i in range(2000))
    p = H.Page(source)
    assert H.extract(p, np.ones(len(p.tag)))[0].split() == [f"t{i}" for i in range(2000)]
