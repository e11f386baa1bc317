import json
import random
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from skeinlake import config, providers
from skeinlake.operators import filters, fulltext, ranking, retrieval, similarity, text_to_query as t2q

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, None), (5, [1.0, 0.0, 0.0]), (6, [1.0, 0.0])]
    return spark.createDataFrame(rows, "vec_id int, embedding array<float>")


def probe(spark, v):
    return spark.createDataFrame([(v,)], "query_vec array<double>")


def test_topk(spark, vectors):
    got = similarity.vector_topk(vectors, probe(spark, [1.0, 0.0]), 10).collect()
    assert [(r.vec_id, round(r.score, 6)) for r in got] == [(1, 1.0), (6, 1.0), (3, round(1 / 1.8, 6)), (2, round(1 / 3, 6))]
    assert [r.vec_id for r in similarity.vector_topk(vectors, probe(spark, [1.0, 0.0]), 10, cutoff=1 / 3).collect()][-1] == 2  # equality keeps
    cosine = similarity.vector_topk(vectors, probe(spark, [2.0, 0.0]), 3, similarity="cosine").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in cosine] == [(1, 1.0), (6, 1.0), (3, 0.8)]


def test_topk_plan(spark, vectors):
    plan = similarity.vector_topk(vectors, probe(spark, [1.0, 0.0]), 3)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def test_topk_many(spark, vectors):
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "query_id int, query_vec array<double>")
    got = similarity.vector_topk_many(vectors, queries, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r["rank"]) for r in got] == [(7, 1, 1), (7, 6, 2), (8, 2, 1), (8, 3, 2)]


def test_influence(spark):
    hits = spark.createDataFrame([("a", 0.5), ("b", 0.2)], "community_key string, score double")
    facts = spark.createDataFrame([("a", "c1", 3), ("a", "c2", 1), ("b", "c2", 2), ("x", "c1", 9)], "community_key string, chunk_id string, cnt bigint")
    got = ranking.chunk_influence(hits, facts, 10).collect()
    assert [(r.chunk_id, round(r.influence, 6)) for r in got] == [("c1", 0.375), ("c2", 0.325)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "Red", 5.0), (2, "green", None), (3, "blue", 9.0)], "id int, name string, x double")

    def ids(rule):
        return [r.id for r in df.where(filters.compile_filter(rule, df.columns)).orderBy("id").collect()]

    assert ids(None) == [1, 2, 3]
    assert ids({"id": 2}) == [2]
    assert ids({"x": {"$gte": 5, "$lt": 9}}) == [1]
    assert ids({"x": {"$ne": 5}}) == [3]
    assert ids({"name": {"$ilike": "RE"}}) == [1, 2] and ids({"name": {"$like": "re"}}) == [2]
    assert ids({"$or": [{"id": 1}, {"x": {"$between": [8, 10]}}]}) == [1, 3]
    assert ids({"id": {"$in": [1, 2]}, "name": {"$nin": ["Red"]}}) == [2]
    for bad in ({"nope": 1}, {"id": {"$regex": "x"}}):
        with pytest.raises(ValueError):
            filters.compile_filter(bad, df.columns)


def test_fulltext(spark):
    docs = spark.createDataFrame([(1, "red fish blue fish"), (2, "one fish"), (3, None), (4, "")], "id int, t string")
    index = fulltext.postings(docs, "id", ["t"])
    got = {r.term: (r.id, r.tf, r.length) for r in index.where("id = 1").collect()}
    assert got == {"red": (1, 1, 4), "fish": (1, 2, 4), "blue": (1, 1, 4)}
    assert [r.id for r in fulltext.search(index, "Blue fish!", 5).collect()] == [1, 2]
    assert fulltext.search(index, "...", 5).count() == 0
    schema = {"A": [("x", "STRING"), ("n", "INTEGER")], "B": [("y", "STRING"), ("z", "STRING")]}
    assert fulltext.text_properties(schema, None, 2) == [("A", "x"), ("B", "y")]
    assert fulltext.text_properties(schema, ["B"], 40) == [("B", "y"), ("B", "z")]


def test_fuse(spark):
    a = spark.createDataFrame([(1, 0.8), (2, 0.4)], "id int, score double")
    b = spark.createDataFrame([(2, 10.0), (3, 5.0)], "id int, score double")
    assert [(r.id, r.score) for r in ranking.fuse(a, b, "id", 5).collect()] == [(1, 1.0), (2, 1.0), (3, 0.5)]
    assert [(r.id, r.score) for r in ranking.fuse(a, b.limit(0), "id", 5).collect()] == [(1, 1.0), (2, 0.5)]


def test_blocks():
    items = [("a" * 1500, "s1", "d1"), ("b" * 1500, "s2", "d1"), ("c" * 1500, "s2", "d2"), ("e" * 5000, "s3", None), ("f", "s4", "d4")]
    got = ranking.pack_blocks(items)
    assert [len(b["block"]) for b in got] == [3001, 1500, 5000, 1]
    assert got[0]["sources"] == ["s1", "s2"] and got[0]["documents"] == ["d1"] and got[2]["documents"] == []
    assert ranking.pack_blocks([]) == []


def test_sentinel(spark):
    df = spark.createDataFrame([("x", 1)], "name string, n int")
    assert ranking.with_sentinel(df, name="NONE").collect() == [("x", 1)]
    assert ranking.with_sentinel(df.limit(0), name="NONE").collect() == [("NONE", None)]


def test_weighted_order(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 1000, 1.0).when(F.col("id") < 1990, 5.0).otherwise(0.0).alias("w"))
    first = [r.id for r in ranking.weighted_order(df, "id", "w", "s").orderBy("draw").limit(300).collect()]
    assert sum(i >= 1000 for i in first) > 220
    assert ranking.weighted_order(df, "id", "w").count() == 1990


class Fixed:
    def __init__(self, sql):
        self.sql = sql

    def translate(self, prompt, schema, examples):
        assert "nodes(" in schema and "Searchable" not in schema
        return self.sql


@pytest.mark.parametrize(
    "sql, fine",
    [
        ("SELECT count(*) AS n FROM nodes", True),
        ("```sql\nWITH a AS (SELECT id FROM nodes) SELECT * FROM a WHERE id > 0;\n```", True),
        ("SELECT ';DROP TABLE nodes' AS x FROM nodes", True),
        ("SELECT id FROM nodes WHERE id IN (SELECT id FROM nodes)", True),
        ("SELECT * FROM other", False),
        ("SELECT * FROM nodes WHERE id IN (SELECT id FROM other)", False),
        ("SELECT * FROM parquet.`/etc`", False),
        ("DROP TABLE nodes", False),
        ("SELECT 1; DROP TABLE nodes", False),
        ("INSERT INTO nodes SELECT 1", False),
        ("SELECT java_method('java.lang.System', 'exit', 1)", False),
        ("SELECT * FROM range(5)", False),
    ],
)
def test_text_to_query(spark, sql, fine):
    views = {"nodes": spark.range(3), "SearchableThing": spark.range(1)}
    if fine:
        assert t2q.text_to_query(spark, "?", views, Fixed(sql))[1].count() >= 1
    else:
        with pytest.raises(ValueError):
            t2q.text_to_query(spark, "?", views, Fixed(sql))


class Moody:
    """Fails, then gives nonsense, then a proper answer."""

    def __init__(self):
        self.calls = 0

    def judge(self, prompt, block):
        self.calls += 1
        if self.calls % 3 == 1:
            raise TimeoutError
        if self.calls % 3 == 2:
            return "I think so"
        return json.dumps({"information": block[:3], "confidence": 80})


class Broken:
    def judge(self, prompt, block):
        return "{}"


def test_judging(spark):
    blocks = spark.createDataFrame([("abcdef",)], "block string")
    assert providers.judge_blocks(blocks, Moody(), "p").select("information", "confidence").collect() == [("abc", 80)]
    assert providers.judge_blocks(blocks, Broken(), "p").select("confidence").collect() == [(0,)]


def test_kernels(spark):
    e = providers.HashEmbedder(64)
    texts = ["red fish swims", "blue bird flies", "green tree grows"]
    chunks = spark.createDataFrame([(f"c{i}", f"d{i}", f"s{i}", t, e.encode([t])[0]) for i, t in enumerate(texts)], "chunk_id string, document string, source string, content string, embedding array<double>")
    got = retrieval.chunk_retrieve("red fish", chunks, e, config.VectorRetrieverConfig(top_k=2)).collect()
    assert len(got) == 2 and got[0].matchedContent == texts[0] and got[0].path == "s0"
    nothing = retrieval.chunk_retrieve("red fish", chunks, e, config.VectorRetrieverConfig(confidence_cutoff=1.0)).collect()
    assert [r.name for r in nothing] == [ranking.NO_DOCUMENTS]
    communities = spark.createDataFrame([(f"k{i}", t, t, e.encode([t])[0]) for i, t in enumerate(texts)], "community_key string, label string, content string, embedding array<double>")
    sources = spark.createDataFrame([("k0", "c0", 3), ("k0", "c1", 1), ("k1", "c1", 1)], "community_key string, chunk_id string, cnt bigint")
    ranked = retrieval.influence_retrieve("red fish swims", communities, sources, chunks, e, config.VectorRetrieverConfig(top_k=5)).collect()
    assert [r.name for r in ranked] == ["d0", "d1"]
    nodes = chunks.select(F.col("chunk_id").alias("id"), "content", "embedding")
    hits = retrieval.graph_vector_retrieve("blue bird", nodes, e, 1, filters={"id": {"$ne": "c0"}}, return_properties=("content",))
    assert hits.columns == ["id", "score", "content"] and hits.first().id == "c1"
    index = fulltext.postings(nodes, "id", ["content"])
    assert retrieval.graph_hybrid_retrieve("green tree", nodes, index, e, 2).first().id == "c2"
    expanded = retrieval.graph_vector_retrieve("blue bird", nodes, e, 1, expansion=retrieval.expand_sql("SELECT h.id, e.cnt FROM hits h JOIN edges e ON e.chunk_id = h.id"), graph={"edges": sources})
    assert {r.cnt for r in expanded.collect()} == {1}


def test_config():
    assert len(config.SUPPORTED) == 30
    c = config.VectorRetrieverConfig(top_k=0, confidence_cutoff=7).clamped()
    assert (c.top_k, c.confidence_cutoff) == (1, 1.0)
    g = config.GlobalRetrieverConfig(top_k=-1, community_degree=-2, confidence_cutoff=140).clamped()
    assert (g.top_k, g.community_degree, g.confidence_cutoff) == (1, 0, 100)
    assert config.VectorRetrieverConfig().update(top_k=3, confidence_cutoff=None) == config.VectorRetrieverConfig(top_k=3)
    with pytest.raises(TypeError):
        config.VectorRetrieverConfig().update(nope=1)


def test_chat():
    history = [{"role": "user", "content": "a"}, {"role": "robot", "content": "b"}, {"role": "assistant", "content": ""}]
    assert [m["role"] for m in providers.create_chat("p", "s", history)] == ["system", "user", "user", "user"]


def test_every_row_is_a_query(spark, monkeypatch):
    """All rows against brute force, over several blocks; ties, nulls and other lengths too."""
    from skeinlake.plans import retrieval_queries as Q

    monkeypatch.setattr(similarity, "BLOCK_ROWS", 7)
    monkeypatch.setattr(similarity, "STEP_SCORES", 20)
    r = random.Random(8)
    vectors = {i: [r.randrange(3) / 2 for _ in range(3)] for i in range(40)} | {90: [1.0, 2.0], 91: [0.0, 0.5], 92: None, 93: [1.0, None, 2.0]}
    table = spark.createDataFrame([(i, v, i % 3) for i, v in vectors.items()], "vec_id bigint, embedding array<float>, label int")
    monkeypatch.setattr(Q, "_table", lambda *_: table)
    got = {}
    for x in Q.knn_all_queries(spark, "").collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    good = {i: v for i, v in vectors.items() if v and None not in v}
    assert set(got) == set(good)
    for i, v in good.items():
        near = sorted((sum((x - y) ** 2 for x, y in zip(v, w)), j) for j, w in good.items() if len(w) == len(v))[:5]
        assert sorted(got[i]) == [(n, j, round(1 / (1 + d), 6)) for n, (d, j) in enumerate(near, 1)]


def test_lanes_stream(spark, monkeypatch):
    """A lane is packed as it comes, not as one group, and gives the blocks of its sorted list."""
    from pyspark.sql import functions as F

    rows = [(i, "t" * (1 + i * 7 % 30), f"s{i}", "d") for i in range(300)]
    docs = spark.createDataFrame(rows, "k int, t string, s string, d string")
    monkeypatch.setattr(ranking, "HANDED_BLOCKS", 3)
    df = ranking.global_blocks(docs, "k", "t", "s", "d", limit=64, lanes=3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInPandas" in plan
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.lane, r.block_no)):
        got.setdefault(r.lane, []).append({"block": r.block, "sources": r.sources, "documents": r.documents})
    keyed = docs.select(F.pmod(F.xxhash64("k"), F.lit(3)).alias("lane"), F.xxhash64("k", F.lit(0)).alias("o"), F.col("k").cast("string").alias("k"), "t", "s", "d").collect()
    for lane in {r.lane for r in keyed}:
        items = [(r.t, r.s, r.d) for r in sorted((r for r in keyed if r.lane == lane), key=lambda r: (r.o, r.k))]
        assert got[lane] == ranking.pack_blocks(items, 64)


def test_texts_are_split_once(spark, monkeypatch):
    """Search without an index reads the texts once and ranks from the counts."""
    docs = spark.createDataFrame([(1, "red fish blue fish"), (2, "one fish"), (3, None), (4, "")], "id int, t string")
    hits = fulltext.search_texts(docs, "id", ["t"], "fish red", 5)
    assert [r.id for r in hits.collect()] == [1, 2]
    assert "regexp" not in hits._jdf.queryExecution().optimizedPlan().toString() and "split" not in hits._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_grow_with_the_table(spark, monkeypatch):
    """Vectors travel to a fixed number of blocks until a block is full, as floats where they are floats; the hits are exact."""
    r = random.Random(8)
    vectors = {i: [float(r.randrange(50)) for _ in range(4)] for i in range(60)}
    table = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 4)
    monkeypatch.setattr(similarity, "BLOCKS", 3)
    hits = similarity.vector_topk_all(table, 2)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(vec_id" in plan and re.findall(r"42\), (\d+)\)", plan) == ["3", "3"] and "array<double>" not in plan
    want = {(q, j) for q, v in vectors.items() for _, j in sorted((sum((x - y) ** 2 for x, y in zip(v, w)), j) for j, w in vectors.items())[:2]}
    assert {(h.query_id, h.vec_id) for h in hits.collect()} == want
