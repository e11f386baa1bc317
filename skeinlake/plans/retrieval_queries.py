"""Registered retrieval queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlake import providers
from skeinlake.config import GlobalRetrieverConfig
from skeinlake.operators import filters, fulltext, ranking, retrieval, similarity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _probe(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> DataFrame:
    emb = _table(spark, sf_dir, "embeddings")
    return emb.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("query_vec"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = similarity.vector_topk(_corpus(spark, sf_dir), _probe(spark, sf_dir), k=10, cutoff=0.04)
    return hits.select("vec_id", "label", F.round("score", 6).alias("score"))


def knn_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = similarity.vector_topk(_corpus(spark, sf_dir), _probe(spark, sf_dir, 1), k=1024, cutoff=0.4)
    return hits.select("vec_id", F.round("score", 6).alias("score"))


def knn_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row whose id is divisible by 20 as a query, against all rows."""
    queries = _corpus(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    hits = similarity.vector_topk_many(_corpus(spark, sf_dir), queries, k=5)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def knn_all_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of the table as a query; ``knn_multi_query`` is the same search for the rows that its SQL names."""
    hits = similarity.vector_topk_all(_corpus(spark, sf_dir), k=5)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def cosine_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corpus(spark, sf_dir)
    rows = rows.where(filters.compile_filter({"label": {"$in": [1, 3, 5]}, "vec_id": {"$gte": 10}}, rows.columns))
    hits = similarity.vector_topk(rows, _probe(spark, sf_dir), k=5, similarity="cosine")
    return hits.select("vec_id", "label", F.round("score", 6).alias("score"))


def influence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = similarity.vector_topk(_corpus(spark, sf_dir), _probe(spark, sf_dir), k=40, cutoff=0.04).select(F.col("vec_id").alias("community_key"), "score")
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("community_key"), F.col("l_orderkey").alias("chunk_id"))
    lines = lines.join(F.broadcast(hits.select("community_key")), "community_key", "left_semi")  # 40 rows at most
    facts = lines.groupBy("community_key", "chunk_id").agg(F.count("*").alias("cnt"))
    top = ranking.chunk_influence(hits, facts, 20)
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), "o_orderpriority")
    rows = orders.join(F.broadcast(top), "chunk_id")
    return rows.select("chunk_id", "o_orderpriority", F.round("influence", 6).alias("influence"))


QUESTION = "the quality of things and ideas that hold"


def fulltext_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fulltext.search_texts(_table(spark, sf_dir, "documents"), "doc_id", ["text"], QUESTION, 20)
    return hits.select("id", F.round("score", 6).alias("score"))


def fulltext_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fulltext.postings(_table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand"])
    return index.select("term", "id", "length", "tf")


def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_vector = similarity.vector_topk(_corpus(spark, sf_dir), _probe(spark, sf_dir), k=20, similarity="cosine").select(F.col("vec_id").alias("id"), "score")
    by_text = fulltext.search_texts(_table(spark, sf_dir, "documents"), "doc_id", ["text"], QUESTION, 20)
    fused = ranking.fuse(by_vector, by_text, "id", 20)
    return fused.select("id", F.round("score", 6).alias("score"))


def expansion_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits as suppliers, expanded by a checked SQL to the nations they deliver from."""
    hits = similarity.vector_topk(_corpus(spark, sf_dir), _probe(spark, sf_dir), k=50).select(F.col("vec_id").alias("id"), F.round("score", 6).alias("score"))
    graph = {"nodes": _table(spark, sf_dir, "supplier"), "edges": _table(spark, sf_dir, "nation")}
    sql = "SELECT h.id, h.score, s.s_name, n.n_name FROM hits h JOIN nodes s ON s.s_suppkey = h.id JOIN edges n ON n.n_nationkey = s.s_nationkey"
    return retrieval.expand_sql(sql)(hits, graph)


def sentinel_when_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = similarity.vector_topk(_corpus(spark, sf_dir), _probe(spark, sf_dir), k=5, cutoff=1.5)
    return ranking.with_sentinel(hits.select(F.col("vec_id").cast("string").alias("name"), F.col("label").cast("string").alias("matched")), name=ranking.NO_DOCUMENTS)


def global_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    blocks = ranking.global_blocks(docs, "doc_id", "text", "doc_id", "source", lanes=8)
    return blocks.select("lane", "block_no", F.length("block").alias("chars"), F.size("sources").alias("texts"), F.size("documents").alias("documents"))


def global_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("community_key"), F.lit(1).alias("degree"), F.col("lang").alias("label"), F.col("text").alias("content"),
        F.col("source").alias("document"), F.lit(False).alias("is_leaf"), F.lit(False).alias("is_copy"),
    )
    config = GlobalRetrieverConfig(top_k=20, confidence_cutoff=10)
    return retrieval.global_retrieve(QUESTION, docs, providers.OverlapJudge(), config, lanes=8).select("name", "path", "type")


_FUNCTIONS = (
    knn_topk, knn_cutoff, knn_multi_query, knn_all_queries, cosine_topk_filtered, influence_rank, fulltext_rank, fulltext_postings, hybrid_rank,
    expansion_rank, sentinel_when_empty, global_blocks, global_answers,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}


def _score(q: str = "q", e: str = "e") -> str:
    return f"1.0 / (1.0 + pow(list_distance({e}.embedding::DOUBLE[], {q}.embedding::DOUBLE[]), 2))"


_COSINE = "(1.0 + list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) / 2.0"
_TERMS = ", ".join(f"'{w}'" for w in sorted(set(QUESTION.split())))
_BM25 = f"""
    w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT count(*) AS n, avg(len(w)) AS mean_length FROM w WHERE len(w) > 0),
    p AS (SELECT id, len(w) AS length, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM w) WHERE term IN ({_TERMS}) GROUP BY id, w, term),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) AS score
           FROM p JOIN f USING (term), s GROUP BY id ORDER BY score DESC, id LIMIT 20)
"""
SQL = {
    "knn_topk": f"""
        SELECT e.vec_id, e.label, round({_score()}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
        WHERE {_score()} >= 0.04 ORDER BY {_score()} DESC, e.vec_id LIMIT 10
    """,
    "knn_cutoff": f"""
        SELECT e.vec_id, round({_score()}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q
        WHERE {_score()} >= 0.4 ORDER BY {_score()} DESC, e.vec_id LIMIT 1024
    """,
    "knn_multi_query": f"""
        SELECT query_id, vec_id, score, rank FROM (
            SELECT q.vec_id AS query_id, e.vec_id, round({_score()}, 6) AS score,
                   (row_number() OVER (PARTITION BY q.vec_id ORDER BY {_score()} DESC, e.vec_id))::INT AS rank
            FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 5
    """,
    "cosine_topk_filtered": f"""
        SELECT e.vec_id, e.label, round({_COSINE}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
        WHERE e.label IN (1, 3, 5) AND e.vec_id >= 10 ORDER BY {_COSINE} DESC, e.vec_id LIMIT 5
    """,
    "influence_rank": f"""
        WITH h AS (SELECT e.vec_id AS k, {_score()} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
                   ORDER BY score DESC, k LIMIT 40),
        f AS (SELECT l_suppkey AS k, l_orderkey AS chunk_id, count(*) AS cnt FROM lineitem GROUP BY 1, 2),
        i AS (SELECT chunk_id, sum(score * cnt / total) AS influence FROM (
                SELECT *, (sum(cnt) OVER (PARTITION BY k))::DOUBLE AS total FROM f) JOIN h USING (k) GROUP BY chunk_id ORDER BY influence DESC, chunk_id LIMIT 20)
        SELECT chunk_id, o_orderpriority, round(influence, 6) AS influence FROM i JOIN orders ON o_orderkey = chunk_id
    """,
    "fulltext_rank": f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM bm",
    "fulltext_postings": """
        WITH w AS (SELECT p_partkey AS id, list_filter(regexp_split_to_array(lower(p_name || ' ' || p_brand), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM part)
        SELECT term, id, len(w)::INT AS length, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM w) GROUP BY term, id, w
    """,
    "hybrid_rank": f"""
        WITH {_BM25}, v AS (SELECT e.vec_id AS id, {_COSINE} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
                            ORDER BY score DESC, id LIMIT 20)
        SELECT id, round(max(score), 6) AS score FROM (
            SELECT id, score / (SELECT max(score) FROM v) AS score FROM v UNION ALL SELECT id, score / (SELECT max(score) FROM bm) FROM bm)
        GROUP BY id ORDER BY max(score) DESC, id LIMIT 20
    """,
    "expansion_rank": f"""
        WITH h AS (SELECT e.vec_id AS id, {_score()} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, id LIMIT 50)
        SELECT id, round(score, 6) AS score, s_name, n_name FROM h JOIN supplier ON s_suppkey = id JOIN nation ON n_nationkey = s_nationkey
    """,
    "sentinel_when_empty": "SELECT 'NO DOCUMENTS FOUND' AS name, NULL::VARCHAR AS matched",
}
