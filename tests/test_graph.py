import random

import pandas as pd
from hypothesis import given, settings, strategies as st
import pytest

from skeinlake.operators import communities as C, graph as G, leiden as L, ranking as R
from skeinlake.providers import LeadSummarizer


@pytest.fixture(scope="module")
def triples(spark):
    rows = [
        ("c1", [("A", "B", "r"), ("A", "B", "r"), ("B", "C", "s"), ("A", "A", "r"), ("", "B", "r"), (None, "B", "r")]),
        ("c2", [("A", "C", "r")]),
        ("c3", []),
        ("c4", None),
    ]
    raw = spark.createDataFrame(rows, "chunk_id string, relations array<struct<From:string,To:string,Relation:string>>")
    return G.valid_triples(raw)


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_build(triples):
    mentions = G.entity_mentions(triples)
    assert pairs(mentions, "entity", "chunk_id", "cnt") == [("A", "c1", 2), ("A", "c2", 1), ("B", "c1", 3), ("C", "c1", 1), ("C", "c2", 1)]
    assert pairs(G.relation_weights(triples), "src", "dst", "label", "weight") == [("A", "B", "r", 2), ("A", "C", "r", 1), ("B", "C", "s", 1)]
    w = {r.entity: round(r.weight, 6) for r in G.entity_weights(mentions).collect()}
    assert w == {"A": 0.833333, "B": 0.5, "C": 0.666667} and round(sum(w.values()), 5) == 2
    assert G.mention_edges_full(mentions).count() == 5
    sparse = G.mention_edges_sparse(G.relation_weights(triples), mentions)
    assert pairs(sparse, "entity", "chunk_id", "weight") == [("A", "c1", 2), ("A", "c2", 1)]


def test_khop_and_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y"), ("z", "z")], "src string, dst string")
    got = pairs(G.khop(edges, spark.createDataFrame([("a",)], "vertex string")), "vertex", "hops")
    assert got == [("b", 1), ("c", 2), ("d", 3)]
    comp = dict(pairs(G.connected_components(edges), "vertex", "component"))
    assert comp == {**{v: "a" for v in "abcde"}, "x": "x", "y": "x", "z": "z"}


def test_description(spark):
    relations = spark.createDataFrame([("X", "a", "r"), ("X", "b", "r"), ("c", "X", "s")] + [("M", f"n{i}", "t") for i in range(7)], "src string, dst string, label string")
    names = ["X", "a", "b", "c", "M", "lone", *(f"n{i}" for i in range(7))]
    labels = spark.createDataFrame([(n, n) for n in names], "vertex string, label string")
    got = {r.vertex: r.description for r in G.node_description(relations, labels).collect()}
    assert got["X"] == "X has relation 'r' with a, b. c have relation 's' with X."
    assert got["lone"] == "lone."
    assert got["M"] == "M has relation 't' with n0, n1, n2, n3, n4. M has relation 't' with n5, n6."
    few = {r.vertex: r.description for r in G.node_description(relations, labels, keep=lambda c: c != "a").collect()}
    assert few["X"] == "X has relation 'r' with b. c have relation 's' with X."


def cpm(adjacent, groups, gamma):
    where = {v: i for i, g in enumerate(groups) for v in g}
    inner = sum(w for v, row in adjacent.items() for u, w in row.items() if u < v and where[u] == where[v])
    return inner - gamma * sum(len(g) * (len(g) - 1) / 2 for g in groups)


def connected(adjacent, group):
    group, seen, stack = set(group), set(), [next(iter(group))]
    while stack:
        v = stack.pop()
        if v not in seen:
            seen.add(v)
            stack += [u for u in adjacent[v] if u in group]
    return seen == group


def random_graph(seed, n, p):
    r = random.Random(seed)
    adjacent = {i: {} for i in range(n)}
    for i in range(n):
        for j in range(i):
            if r.random() < (p if i % 3 == j % 3 else p / 8):
                adjacent[i][j] = adjacent[j][i] = r.choice([1.0, 2.0])
    return adjacent


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.floats(0.05, 0.9), st.floats(0.01, 1.0))
def test_leiden_invariants(seed, n, p, gamma):
    g = random_graph(seed, n, p)
    groups = L.leiden(g, gamma)
    assert sorted(v for c in groups for v in c) == list(range(n))
    assert all(connected(g, c) for c in groups)
    assert cpm(g, groups, gamma) >= -1e-9  # no worse than every vertex alone
    assert groups == L.leiden(g, gamma)


def test_leiden_finds_cliques():
    g = {i: {} for i in range(30)}
    for c in range(3):
        for i in range(10 * c, 10 * c + 10):
            for j in range(10 * c, 10 * c + 10):
                if i != j:
                    g[i][j] = 1.0
    g[9][10] = g[10][9] = g[19][20] = g[20][19] = 1.0
    assert L.leiden(g, 0.5) == [list(range(10)), list(range(10, 20)), list(range(20, 30))]


def test_hierarchy_divides_large():
    g = random_graph(4, 90, 0.7)
    assert L.hierarchy(g, 0.01) == [[list(range(90))]]  # in one piece at twice the resolution too: that ends it
    levels = L.hierarchy(g, 0.2)
    assert 1 <= len(levels) <= L.MAX_DEPTH
    for above, below in zip(levels, levels[1:]):
        for c in below:
            assert any(set(c) <= set(a) for a in above)
    assert max(map(len, levels[-1])) < 90


def test_resolution():
    assert abs(L.resolution(5) - 0.5525) < 1e-12


@pytest.fixture(scope="module")
def community_graph(spark):
    rows = []
    for c in range(3):
        for i in range(6):
            rows += [(f"v{c}{i}", f"v{c}{j}", 1.0) for j in range(i)]
    rows += [("v00", "v10", 1.0), ("w0", "w1", 1.0)]
    return G.undirected(spark.createDataFrame(rows, "src string, dst string, weight double"))


def test_community_tables(spark, community_graph):
    levels = L.leiden_communities(community_graph, gamma=0.3)
    got = [(r.vertex, r.level, r.community) for r in levels.collect()]
    vertices = {v for v, _, _ in got}
    assert len(vertices) == 20
    for level in {x for _, x, _ in got}:
        assert {v for v, x, _ in got if x == level} == vertices
    flat = {v: c for v, x, c in got if x == 1}
    assert len({flat[f"v0{i}"] for i in range(6)}) == 1 and flat["v00"] != flat["v10"] and flat["w0"] == flat["w1"]
    members = C.community_tables(levels).cache()
    height = members.agg({"level": "max"}).first()[0]
    assert members.where(f"level = {height}").select("community_key").distinct().count() == 20
    edges = C.community_edges(members, community_graph).collect()
    parents = {}
    for e in edges:
        assert e.child_key not in parents
        parents[e.child_key] = e.parent_key
    assert "00000/00000" in parents.values()
    paths = C.vertex_communities(members).collect()
    assert all(len(r.communities) == height + 1 for r in paths)


def test_summaries(spark):
    leaves = [(f"00002/0000{i}", f"label {i}", f"content number {i} that says something", float(i + 1), True, False) for i in range(4)]
    nodes = spark.createDataFrame(leaves, C._NODE)
    edges = [("00001/00000", f"00002/0000{i}", 1.0) for i in range(3)] + [("00001/00001", "00002/00003", 1.0), ("00000/00000", "00001/00000", 1.0), ("00000/00000", "00001/00001", 0.0)]
    done = {r.community_key: r for r in C.summarize_levels(nodes, spark.createDataFrame(edges, "parent_key string, child_key string, weight double"), [0, 1], LeadSummarizer()).collect()}
    assert len(done) == 7
    assert done["00001/00001"].content == leaves[3][2] and done["00001/00001"].is_leaf and done["00002/00003"].is_copy
    assert done["00001/00000"].weight == 6 and not done["00001/00000"].is_leaf
    assert done["00000/00000"].weight == 10 and len(done["00000/00000"].label) >= 5


def test_gather():
    child = lambda k, n, w, leaf=True: {"key": k, "text": k * n, "weight": w, "is_leaf": leaf}
    text, weight = C.gather([child("a", 10, 1.0), child("b", 50, 2.0), child("z", 5, 0.0)], {}, 30)
    assert text == "a" * 10 and weight == 1.0
    grand = {"a": [{"text": "x" * 12, "weight": 4.0}]}
    text, weight = C.gather([child("a", 10, 1.0, False), child("b", 5, 2.0)], grand, 30)
    assert sorted(text) == sorted("x" * 12 + "b" * 5) and weight == 6.0


def test_signatures_and_reuse(spark):
    members = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k2", "c")], "community_key string, vertex string")
    relations = spark.createDataFrame([("a", "b", "r")], "src string, dst string, label string")
    s1 = {r.community_key: r.signature for r in C.signatures(members, relations).collect()}
    changed = spark.createDataFrame([("a", "b", "r"), ("c", "x", "r")], "src string, dst string, label string")
    s2 = {r.community_key: r.signature for r in C.signatures(members, changed).collect()}
    assert s1["k1"] == s2["k1"] and s1["k2"] != s2["k2"]
    old = spark.createDataFrame([("o", s1["k1"], "label", "content", 2.0)], "community_key string, signature string, label string, content string, weight double")
    assert [(r.community_key, r.content) for r in C.reuse(C.signatures(members, relations), old).collect()] == [("k1", "content")]


def test_global_index(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 200)], "x int").repartition(5)
    got = [(r.x, r.i) for r in R.global_index(df, ["x"], "i").collect()]
    assert [x for x, _ in sorted(got, key=lambda t: t[1])] == sorted(x for x, _ in got)
    assert sorted(i for _, i in got) == list(range(200))


def test_graph_of_near_vectors(spark, monkeypatch):
    """Edges join nearest vectors, by brute force, not vectors of like axes; nothing but vectors is in a community."""
    from skeinlake.plans import graph_queries as Q

    r = random.Random(6)
    vectors = {i: [(1 if i % 2 else -1) * (3 - x) + r.random() / 4 for x in range(4)] for i in range(24)}
    table = spark.createDataFrame([(i, v, i % 3) for i, v in vectors.items()], "vec_id bigint, embedding array<double>, label int")
    monkeypatch.setattr(Q, "_table", lambda *_: table)
    sizes = Q.leiden_hierarchy(spark, "").collect()
    assert all(sum(x.size for x in sizes if x.level == n) == len(vectors) for n in {x.level for x in sizes})
    want = set()
    for i, v in vectors.items():
        near = sorted((sum((x - y) ** 2 for x, y in zip(v, w)), j) for j, w in vectors.items() if j != i)[:3]
        want |= {(f"E{i:08d}", f"E{j:08d}") for _, j in near}
    assert {(e.src, e.dst) for e in Q._near(spark, "").collect()} == want


def test_sparse_mentions_of_the_order_graph(spark, monkeypatch):
    """The registered cover runs on customers, parts and orders, and equals a plain search from each entity."""
    from skeinlake.plans import graph_queries as Q

    r = random.Random(12)
    orders = [(o, r.randrange(9), "F") for o in range(40)]
    lines = [(o, r.randrange(14)) for o, _, _ in orders for _ in range(r.randrange(1, 4))]
    tables = {"orders": spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string"), "lineitem": spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint")}
    monkeypatch.setattr(Q, "_table", lambda _, __, name: tables[name])
    customer = {o: f"Customer_{c}" for o, c, _ in orders}
    near, wanted = {}, {}
    for o, p in lines:
        near.setdefault(customer[o], set()).add(f"Part_{p}")
        near.setdefault(f"Part_{p}", set()).add(customer[o])
        for e in (customer[o], f"Part_{p}"):
            wanted.setdefault(e, {})
            wanted[e][str(o)] = wanted[e].get(str(o), 0) + 1
    want = set()
    for e in sorted(wanted):
        ball = {e}
        for _ in range(3):
            ball |= {w for v in ball for w in near.get(v, ())}
        for o in sorted(set(wanted[e]) - ball):
            near[e].add(o)
            near.setdefault(o, set()).add(e)
            want.add((e, o, wanted[e][o]))
    assert {tuple(x) for x in Q.mention_edges_sparse(spark, "").collect()} == want


def test_all_levels(spark):
    from skeinlake.plans import graph_queries as Q

    folder = "/root/testdata/sf0.001"
    rollup = Q.community_rollup_all(spark, folder).selectExpr("left(community_key, 5) AS level").distinct().collect()
    edges = Q.two_level_edge_weight_all(spark, folder).selectExpr("left(child_key, 5) AS level").distinct().collect()
    assert sorted(x.level for x in rollup) == ["00000", "00001", "00002", "00003"]
    assert sorted(x.level for x in edges) == ["00001", "00002", "00003"]


def test_sparse_cover_by_chunk(spark, monkeypatch):
    """Up to three hops the cover goes chunk by chunk, with or without the last step, and equals the greedy search in one order."""
    r = random.Random(5)
    pairs = {tuple(sorted(r.sample(range(40), 2))) for _ in range(45)}
    relations = [(f"e{a:02d}", f"e{b:02d}", "x", 1) for a, b in sorted(pairs)]
    mentions = [(f"e{e:02d}", c, r.randrange(1, 4)) for c in range(12) for e in r.sample(range(40), 14)]
    rel = spark.createDataFrame(relations, "src string, dst string, label string, weight bigint")
    men = spark.createDataFrame(mentions, "entity string, chunk_id bigint, cnt bigint")
    monkeypatch.setattr(G, "connected_components", lambda *_: pytest.fail("one group a component"))
    rows = pd.DataFrame([("r", a, b, 0) for a, b, _, _ in relations] + [("m", e, str(c), n) for e, c, n in mentions], columns=["kind", "a", "b", "n"])
    for hops, limit in ((1, 0), (2, 0), (3, 0), (3, 10**9)):
        monkeypatch.setattr(G, "COVER_PAIRS", limit)
        got = sorted(tuple(x) for x in G.mention_edges_sparse(rel, men, hops).collect())
        assert got == sorted(G._cover(rows, hops))


def test_tasks_of_triples_stay_small(spark, monkeypatch):
    """Partitions follow the rows, and what goes by chunk isn't shuffled again."""
    from skeinlake import storage
    from skeinlake.plans import graph_queries as Q

    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    folder = "/root/testdata/sf0.001"
    mentions = Q.entity_mentions(spark, folder)
    lines = Q._table(spark, folder, "lineitem").count()
    assert mentions.rdd.getNumPartitions() == -(-lines // 500)
    assert mentions._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(chunk_id") == 0


def test_shared_edges_without_pairs(spark):
    """Weights by counting within items equal those of the graph of all pairs, at every level, with repeated and null rows."""
    r = random.Random(3)
    top = {f"v{i:02d}": (i % 3, i % 3 * 10 + i % 2) for i in range(20)}
    levels = [(v, n, c) for v, (a, b) in top.items() for n, c in ((0, "root"), (1, f"a{a}"), (2, f"b{b:02d}"))]
    held = [(f"v{r.randrange(23):02d}", r.randrange(6)) for _ in range(90)] + [(None, 1), ("v01", None)]
    members = C.community_tables(spark.createDataFrame(levels, "vertex string, level int, community string")).cache()
    own = set(held)
    weights = {}
    for v, x in own:
        for w, y in own:
            if v and w and x is not None and x == y and v != w:
                weights[v, w] = weights.get((v, w), 0.0) + 1.0
    edges = spark.createDataFrame([(a, b, n) for (a, b), n in weights.items()], "src string, dst string, weight double")
    shared = C.shared_community_edges(members, spark.createDataFrame(held, "vertex string, item bigint"), 3)
    cols = ("parent_key", "child_key", "weight")
    assert pairs(shared, *cols) == pairs(C.community_edges(members, edges), *cols)
    assert any(x[2] > 1 for x in pairs(shared, *cols))


def test_tasks_of_the_rollup_stay_small(spark, monkeypatch):
    """A fact is shuffled once, not once for each community; partitions follow the facts."""
    from skeinlake import storage
    from skeinlake.plans import graph_queries as Q

    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    folder = "/root/testdata/sf0.001"
    df = Q.community_rollup_all(spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(community_key" not in plan and "Exchange hashpartitioning(chunk_id" in plan
    assert df.rdd.getNumPartitions() == -(-Q._table(spark, folder, "lineitem").count() // 500)
