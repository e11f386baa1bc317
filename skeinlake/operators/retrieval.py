"""Retrieval kernels: prompt to ranked answers, each one lazy plan over stored tables.

Answers have the columns of ``ANSWER``. Where nothing is found there is one row that says so.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skeinlake import providers
from skeinlake.config import GlobalRetrieverConfig, VectorRetrieverConfig
from skeinlake.operators import filters as flt, fulltext, ranking, similarity

ANSWER = (
    "name string, category string, path string, type string, matchedContent string, "
    "surroundingContent array<string>, links array<string>"
)


def _answers(rows: DataFrame, name: Column, content: Column, path: Column, surrounding: Column | None = None, order: list[Column] | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    out = rows.orderBy(*order) if order else rows
    out = out.select(
        name.cast("string").alias("name"), F.lit("document").alias("category"), path.cast("string").alias("path"), F.lit("text").alias("type"),
        content.cast("string").alias("matchedContent"), (surrounding if surrounding is not None else none).alias("surroundingContent"), none.alias("links"),
    )
    return ranking.with_sentinel(out, name=ranking.NO_DOCUMENTS, category="", path="", type="text", matchedContent=ranking.NO_DOCUMENTS)


def prompt_vector(spark: SparkSession, prompt: str, embedder: providers.Embedder) -> DataFrame:
    """One row with ``query_vec``; the prompt is embedded once, on the driver."""
    return spark.createDataFrame([(embedder.encode([prompt])[0],)], "query_vec array<double>")


def vector_hits(prompt: str, table: DataFrame, embedder: providers.Embedder, config: VectorRetrieverConfig, id_col: str, k: int | None = None) -> DataFrame:
    """Rows of a vector table with ``score``: the best ``top_k`` at or above the cutoff."""
    c = config.clamped()
    query = prompt_vector(table.sparkSession, prompt, embedder)
    return similarity.vector_topk(table, query, k or c.top_k, c.confidence_cutoff, id_col=id_col)


def chunk_retrieve(prompt: str, chunks: DataFrame, embedder: providers.Embedder, config: VectorRetrieverConfig = VectorRetrieverConfig()) -> DataFrame:
    """Vector search over chunks (chunk_id, document, source, content, embedding)."""
    hits = vector_hits(prompt, chunks, embedder, config, "chunk_id")
    return _answers(hits, F.col("document"), F.col("content"), F.col("source"), order=[F.desc("score"), F.col("chunk_id")])


def community_retrieve(prompt: str, communities: DataFrame, embedder: providers.Embedder, config: VectorRetrieverConfig = VectorRetrieverConfig()) -> DataFrame:
    """Vector search over community summaries (community_key, label, content, embedding)."""
    hits = vector_hits(prompt, communities, embedder, config, "community_key")
    return _answers(hits, F.col("label"), F.col("content"), F.col("community_key"), order=[F.desc("score"), F.col("community_key")])


def influence_retrieve(
    prompt: str, communities: DataFrame, sources: DataFrame, chunks: DataFrame, embedder: providers.Embedder, config: VectorRetrieverConfig = VectorRetrieverConfig()
) -> DataFrame:
    """Chunks ranked by the communities that match: twice ``top_k`` communities at or above the cutoff spread their scores over the
    chunks they come from. ``sources(community_key, chunk_id, cnt)``."""
    c = config.clamped()
    hits = vector_hits(prompt, communities, embedder, config, "community_key", 2 * c.top_k).select("community_key", "score")
    top = ranking.chunk_influence(hits, sources, c.top_k)
    rows = chunks.join(F.broadcast(top), "chunk_id")  # at most top_k rows
    return _answers(rows, F.col("document"), F.col("content"), F.col("source"), order=[F.desc("influence"), F.col("chunk_id")])


def global_retrieve(prompt: str, communities: DataFrame, judge: providers.Judge, config: GlobalRetrieverConfig = GlobalRetrieverConfig(), seed: int = 0, lanes: int | None = None) -> DataFrame:
    """All communities down to a degree, shuffled, packed into blocks and judged; the best answers by confidence.

    ``communities(community_key, degree, label, content, document, is_leaf, is_copy)``.
    """
    c = config.clamped()
    wanted = communities.where((F.col("degree") <= c.community_degree) & ~F.col("is_copy") & ~F.col("is_leaf"))
    text = wanted.withColumn("__text", F.concat_ws(": ", "label", "content"))
    blocks = ranking.global_blocks(text, "community_key", "__text", "community_key", "document", seed, lanes=lanes)
    judged = providers.judge_blocks(blocks, judge, prompt)
    best = judged.where(F.col("confidence") >= c.confidence_cutoff).orderBy(F.desc("confidence"), "lane", "block_no").limit(c.top_k)
    return _answers(best, F.array_join("documents", ", "), F.col("information"), F.array_join("sources", ", "), F.array("block"), [F.desc("confidence"), F.col("lane"), F.col("block_no")])


Expansion = Callable[[DataFrame, dict[str, DataFrame]], DataFrame]


def expand_sql(sql: str) -> Expansion:
    """An expansion from a SELECT over the views ``hits``, ``nodes`` and ``edges``, checked before it runs."""

    def run(hits: DataFrame, graph: dict[str, DataFrame]) -> DataFrame:
        from skeinlake.operators.text_to_query import checked_query

        return checked_query(hits.sparkSession, sql, {"hits": hits, **graph})

    return run


def graph_vector_retrieve(
    prompt: str,
    nodes: DataFrame,
    embedder: providers.Embedder,
    top_k: int = 5,
    filters: dict[str, Any] | None = None,
    return_properties: tuple[str, ...] | None = None,
    expansion: Expansion | None = None,
    graph: dict[str, DataFrame] | None = None,
    similarity_fn: str = "cosine",
) -> DataFrame:
    """Nodes (id, ..., embedding) nearest to the prompt among those the filter admits; projected, or expanded by joins."""
    rows = nodes.where(flt.compile_filter(filters, nodes.columns))
    hits = similarity.vector_topk(rows, prompt_vector(nodes.sparkSession, prompt, embedder), max(1, top_k), 0.0, similarity_fn, "id")
    return _finish(hits, return_properties, expansion, graph)


def graph_hybrid_retrieve(
    prompt: str,
    nodes: DataFrame,
    index: DataFrame,
    embedder: providers.Embedder,
    top_k: int = 5,
    return_properties: tuple[str, ...] | None = None,
    expansion: Expansion | None = None,
    graph: dict[str, DataFrame] | None = None,
    similarity_fn: str = "cosine",
) -> DataFrame:
    """Vector and full-text hits fused: each list scaled by its best score, the better one of a node counts."""
    k = max(1, top_k)
    by_vector = similarity.vector_topk(nodes, prompt_vector(nodes.sparkSession, prompt, embedder), k, 0.0, similarity_fn, "id").select("id", "score")
    by_text = fulltext.search(index, prompt, k)
    fused = ranking.fuse(by_vector, by_text, "id", k)
    hits = nodes.join(F.broadcast(fused), "id").orderBy(F.desc("score"), "id")  # k rows
    return _finish(hits, return_properties, expansion, graph)


def _finish(hits: DataFrame, return_properties: tuple[str, ...] | None, expansion: Expansion | None, graph: dict[str, DataFrame] | None) -> DataFrame:
    if expansion:
        return expansion(hits, graph or {})
    if return_properties:
        return hits.select("id", "score", *(flt.field(p, hits.columns).alias(p) for p in return_properties if p not in ("id", "score")))
    return hits.drop("embedding")


def answer(prompt: str, hits: DataFrame, answerer: providers.Answerer, text_col: str, limit: int | None = None) -> dict[str, Any]:
    """A model's answer from the texts of all hits, which are a top list; ``limit`` is for tables of unknown size."""
    rows = (hits if limit is None else hits.limit(limit)).collect()
    return {"answer": answerer.answer(prompt, [str(r[text_col]) for r in rows]), "retriever_result": rows}
