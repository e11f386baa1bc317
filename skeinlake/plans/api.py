"""The facade: index a folder, then query it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlake import config as C, providers
from skeinlake.functions import text as T
from skeinlake.operators import chunking, communities, fulltext, graph, leiden, retrieval, text_to_query
from skeinlake.sources import files
from skeinlake.sources.tables import Warehouse


class Engine:
    """An indexer and a retriever over one warehouse folder. Every stage is a table; a stage reads only tables."""

    def __init__(
        self,
        spark: SparkSession,
        warehouse: str,
        indexer: str | None = C.DEFAULT_PAIR[0],
        retriever: str | None = C.DEFAULT_PAIR[1],
        embedder: providers.Embedder | None = None,
        extractor: providers.Extractor | None = None,
        summarizer: providers.Summarizer | None = None,
        judge: providers.Judge | None = None,
        answerer: providers.Answerer | None = None,
        translator: providers.Translator | None = None,
        index_config: Any = None,
        retrieval_config: Any = None,
    ):
        if (indexer, retriever) not in C.SUPPORTED:
            raise ValueError(f"indexer {indexer!r} and retriever {retriever!r} don't go together")
        self.spark, self.tables = spark, Warehouse(spark, warehouse)
        self.indexer, self.retriever = indexer, retriever
        self.embedder = embedder or providers.HashEmbedder()
        self.extractor = extractor or providers.PatternExtractor()
        self.summarizer = summarizer or providers.LeadSummarizer()
        self.judge = judge or providers.OverlapJudge()
        self.answerer = answerer or providers.ContextAnswerer()
        self.translator = translator
        self.index_config = index_config or (C.INDEXERS[indexer]() if indexer else None)
        self.retrieval_config = retrieval_config or (C.RETRIEVERS[retriever]() if retriever else None)

    # indexing

    def index(self, folder: str | None = None) -> None:
        """Build all tables of the indexer; new files only are read if chunks are there already."""
        if self.indexer is None:
            raise ValueError("no indexer was chosen")
        if self.indexer == "template":
            return
        if self.indexer in ("graph_vector", "graph_hybrid"):
            self.index_graph()
            return
        if folder is None:
            raise ValueError("a folder of documents is needed")
        self.load(folder)
        if self.indexer == "chunk":
            return
        self.extract()
        self.weigh()
        self.cluster()
        self.summarize()

    def load(self, folder: str) -> None:
        """Files to chunks with vectors; errors to their own table."""
        manifest = self.tables.read("manifest") if self.tables.exists("manifest") else None
        listing = files.list_files(self.spark, folder).select("path", "modificationTime")
        pages, errors = files.load_documents(self.spark, folder, manifest)
        pages = self.tables.write("__pages", pages)
        seen = listing.select("path", F.col("modificationTime").cast("string").alias("file_time"))
        chunks = chunking.chunk_documents(pages, self.index_config.max_chunk_size, "path").join(pages.select("path", "file"), "path").join(seen, "path")
        rows = chunks.select(
            F.sha2(F.concat_ws("#", "path", "file_time", F.col("chunk_no").cast("string")), 256).alias("chunk_id"), F.col("file").alias("document"),
            F.concat_ws(" ", "file", "page_hint").alias("source"), T.chunk_label(F.col("file"), F.col("h1")).alias("label"), "content", "page_hint",
            F.lit(1.0).alias("weight"), F.col("path").alias("file_path"), "file_time",
        ).withColumn("embedding", providers.embed(F.col("content"), self.embedder))
        self._add_chunks(rows, seen)
        self.tables.write("errors", errors, mode="append")
        self.tables.write("manifest", listing)
        self.tables.drop("__pages")

    def _add_chunks(self, rows: DataFrame, seen: DataFrame) -> None:
        """New chunks come in once, however often a load is begun; those of earlier states of edited files go, with what was
        read from them."""
        if not self.tables.exists("chunks"):
            self.tables.write("chunks", rows)
            return
        old = self.tables.read("chunks")
        fresh = rows.join(old.select("chunk_id"), "chunk_id", "left_anti")
        now = seen.select(F.col("path").alias("file_path"), F.col("file_time").alias("now"))
        stale = self.tables.write("__stale", old.join(now, "file_path").where("file_time <> now").select("chunk_id"))
        if stale.isEmpty():
            self.tables.write("chunks", fresh, mode="append")
        else:
            for name in ("triples", "processed"):
                if self.tables.exists(name):
                    self.tables.write(name, self.tables.read(name).join(stale, "chunk_id", "left_anti"))
            self.tables.write("chunks", old.join(stale, "chunk_id", "left_anti").unionByName(fresh))
        self.tables.drop("__stale")

    def extract(self) -> None:
        """Triples of chunks that have none yet."""
        chunks = self.tables.read("chunks").select("chunk_id", "content")
        self.tables.create_if_missing("processed", "chunk_id string")
        fresh = chunks.join(self.tables.read("processed"), "chunk_id", "left_anti")
        found = providers.extract_relations(fresh, self.extractor).select("chunk_id", "relations")
        found = self.tables.write("__found", found)
        self.tables.create_if_missing("triples", "chunk_id string, src string, dst string, label string")
        self.tables.write("triples", graph.valid_triples(found), mode="append")
        self.tables.write("processed", found.select("chunk_id"), mode="append")
        self.tables.drop("__found")

    def weigh(self, sparse: bool = True) -> None:
        triples = self.tables.read("triples")
        mentions = self.tables.write("mentions", graph.entity_mentions(triples))
        relations = self.tables.write("relations", graph.relation_weights(triples))
        edges = graph.mention_edges_sparse(relations, mentions) if sparse else graph.mention_edges_full(mentions)
        self.tables.write("mention_edges", edges)
        weights = graph.entity_weights(mentions)
        self.tables.write("entities", weights.withColumn("label", T.display_label(F.col("entity"))))

    def cluster(self) -> None:
        """Communities of entities and chunks together."""
        relations, mentions = self.tables.read("relations"), self.tables.read("mention_edges")
        both = graph.undirected(relations, mentions.select(F.col("entity").alias("src"), F.col("chunk_id").alias("dst"), "weight"))
        edges = self.tables.write("edges", both)
        members = communities.community_tables(leiden.leiden_communities(edges))
        members = self.tables.write("community_members", members)
        self.tables.write("community_edges", communities.community_edges(members, edges))
        facts = self.tables.read("mentions").select("entity", "chunk_id", "cnt")
        own = self.tables.read("chunks").select(F.col("chunk_id").alias("entity"), "chunk_id", F.lit(1).cast("bigint").alias("cnt"))
        self.tables.write("community_sources", communities.rollup(members, facts.unionByName(own), "chunk_id"))

    def summarize(self) -> None:
        members, edges = self.tables.read("community_members"), self.tables.read("community_edges")
        chunks, entities = self.tables.read("chunks"), self.tables.read("entities")
        labels = entities.select(F.col("entity").alias("vertex"), "label").unionByName(chunks.select(F.col("chunk_id").alias("vertex"), "label"))
        weights = entities.select("entity", "weight").unionByName(chunks.select(F.col("chunk_id").alias("entity"), "weight"))
        described = graph.node_description(self.tables.read("relations"), labels)
        described = described.join(chunks.select(F.col("chunk_id").alias("vertex"), "content"), "vertex", "left")
        described = described.select("vertex", F.coalesce("content", "description").alias("description"))
        leaves = communities.leaf_nodes(members, described, labels, weights)
        height = members.agg(F.max("level")).first()[0] or 0
        signed = self.tables.write("__signed", communities.signatures(members, self.tables.read("relations")))
        known = communities.reuse(signed, self.tables.read("summaries")) if self.tables.exists("summaries") else None
        done = communities.summarize_levels(leaves, edges, list(range(height)), self.summarizer, known=known)
        document = self.tables.read("community_sources").join(chunks.select("chunk_id", "document"), "chunk_id").groupBy("community_key").agg(F.min("document").alias("document"))
        nodes = done.withColumn("degree", F.split_part("community_key", F.lit("/"), F.lit(1)).cast("int")).join(document, "community_key", "left")
        nodes = self.tables.write("communities", nodes, ("degree",))
        summaries = nodes.where("NOT is_leaf AND NOT is_copy").join(signed, "community_key")
        self.tables.write("summaries", summaries.select("signature", "community_key", "label", "content", "weight"))
        self.tables.drop("__signed")
        self.tables.write("community_vectors", communities.embed_communities(nodes, self.embedder))

    def index_graph(self) -> None:
        """Vectors, and for hybrid search postings, of the property-graph table ``nodes(id, labels, props)``."""
        nodes = self.tables.read("nodes")
        text = T.node_text(F.col("labels"), F.col("props"))
        self.tables.write("node_vectors", nodes.withColumn("content", text).withColumn("embedding", providers.embed(F.col("content"), self.embedder)))
        if self.indexer == "graph_hybrid":
            c = self.index_config
            present = nodes.select(F.explode("labels").alias("label"), F.explode(F.map_keys("props")).alias("name")).distinct()
            schema: dict[str, list[tuple[str, str]]] = {}
            for r in present.collect():  # the graph's schema, not its rows
                schema.setdefault(r["label"], []).append((r["name"], "STRING"))
            chosen = fulltext.text_properties(schema, list(c.target_nodes) if c.target_nodes else None, c.property_limit)
            names = sorted({name for _, name in chosen})
            flat = nodes.select("id", *(F.col("props")[n].alias(n) for n in names))
            self.tables.write("node_postings", fulltext.postings(flat, "id", names))

    # querying

    def query(self, prompt: str, expansion: retrieval.Expansion | str | None = None, **changes: Any) -> DataFrame:
        """Ranked answers of the retriever; ``changes`` override its settings for this call.

        ``expansion`` is used by the expanding retrievers and ignored by the others.
        """
        if self.retriever is None:
            raise ValueError("no retriever was chosen")
        c = self.retrieval_config.update(**changes)
        t = self.tables
        if isinstance(expansion, str):
            expansion = retrieval.expand_sql(expansion)
        match self.retriever:
            case "chunk":
                return retrieval.chunk_retrieve(prompt, t.read("chunks"), self.embedder, c)
            case "community":
                return retrieval.community_retrieve(prompt, t.read("community_vectors"), self.embedder, c)
            case "influence":
                return retrieval.influence_retrieve(prompt, t.read("community_vectors"), t.read("community_sources"), t.read("chunks"), self.embedder, c)
            case "global":
                return retrieval.global_retrieve(prompt, t.read("communities"), self.judge, c)
            case "text_to_query":
                return self.text_to_query(prompt)[1]
        graph_tables = {n: t.read(n) for n in ("nodes", "edges") if t.exists(n)}
        expand = expansion if self.retriever.endswith("_expansion") else None
        if self.retriever.startswith("graph_vector"):
            return retrieval.graph_vector_retrieve(
                prompt, t.read("node_vectors"), self.embedder, c.top_k, c.filters, c.return_properties, expand, graph_tables, self._similarity()
            )
        return retrieval.graph_hybrid_retrieve(
            prompt, t.read("node_vectors"), t.read("node_postings"), self.embedder, c.top_k, c.return_properties, expand, graph_tables, self._similarity()
        )

    def _similarity(self) -> str:
        return getattr(self.index_config, "similarity_fn", "cosine")

    def text_to_query(self, prompt: str) -> tuple[str, DataFrame]:
        """The SQL of the translator, checked, and its rows."""
        if self.translator is None:
            raise ValueError("a translator is needed")
        views = {n: self.tables.read(n) for n in self.tables.names()}
        return text_to_query.text_to_query(self.spark, prompt, views, self.translator, self.retrieval_config.examples)

    def answer(self, prompt: str, text_col: str = "content", **changes: Any) -> dict[str, Any]:
        """A model's answer from the hits of the retriever."""
        return retrieval.answer(prompt, self.query(prompt, **changes), self.answerer, text_col)


def retrieve(engine: Engine, request: dict[str, Any]) -> DataFrame:
    """A wire request (latestUserPrompt, latestUserPromptType, parameters, maxMatches) to answers.

    Only text prompts are answered; parameters are those the retriever's settings know, with JSON values.
    """
    import dataclasses
    import json

    if str(request.get("latestUserPromptType", "text")).lower() not in ("text", "none"):
        raise ValueError("only text prompts are answered")
    known = {f.name for f in dataclasses.fields(engine.retrieval_config)}
    changes: dict[str, Any] = {}
    for name, value in (request.get("parameters") or {}).items():
        if name in known:
            try:
                changes[name] = json.loads(value)
            except (ValueError, TypeError):
                changes[name] = value
    if request.get("maxMatches"):
        changes["top_k"] = int(request["maxMatches"])
    return engine.query(request["latestUserPrompt"], **changes)
