"""Settings of indexers and retrievers as frozen dataclasses, with the limits their values are held to."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class _Config:
    def update(self, **changes: Any) -> _Config:
        """A copy with some fields changed; None leaves a field as it is, unknown names are an error."""
        names = {f.name for f in dataclasses.fields(self)}
        if unknown := set(changes) - names:
            raise TypeError(f"{type(self).__name__} has no {', '.join(sorted(unknown))}")
        return dataclasses.replace(self, **{k: v for k, v in changes.items() if v is not None})


@dataclass(frozen=True)
class ChunkingConfig(_Config):
    """Indexers that chunk files."""

    max_chunk_size: int = 4096


@dataclass(frozen=True)
class VectorGraphIndexConfig(_Config):
    similarity_fn: str = "cosine"
    v_index_name: str = "vector_index_all"


@dataclass(frozen=True)
class HybridGraphIndexConfig(VectorGraphIndexConfig):
    f_index_name: str = "ft_index_all"
    target_nodes: tuple[str, ...] | None = None
    property_limit: int = 40


@dataclass(frozen=True)
class TemplateIndexConfig(_Config):
    chunk_size: int = 600
    chunk_overlap: int = 64


@dataclass(frozen=True)
class VectorRetrieverConfig(_Config):
    """Retrieval by the vectors of chunks or communities."""

    top_k: int = 1024
    confidence_cutoff: float = 0.04
    vector_db_index_name: str = ""

    def clamped(self) -> VectorRetrieverConfig:
        return dataclasses.replace(self, top_k=max(1, int(self.top_k)), confidence_cutoff=min(1.0, max(0.0, float(self.confidence_cutoff))))


@dataclass(frozen=True)
class GlobalRetrieverConfig(_Config):
    """Community-wide retrieval; the cutoff is a percentage."""

    top_k: int = 1024
    community_degree: int = 1
    confidence_cutoff: int = 40

    def clamped(self) -> GlobalRetrieverConfig:
        return dataclasses.replace(
            self,
            top_k=max(1, int(self.top_k)),
            community_degree=max(0, int(self.community_degree)),
            confidence_cutoff=min(100, max(0, int(self.confidence_cutoff))),
        )


@dataclass(frozen=True)
class GraphVectorRetrieverConfig(_Config):
    top_k: int = 5
    return_properties: tuple[str, ...] | None = None
    filters: dict[str, Any] | None = None


@dataclass(frozen=True)
class GraphVectorExpansionConfig(GraphVectorRetrieverConfig):
    """With a retrieval query that expands the hits."""


@dataclass(frozen=True)
class HybridRetrieverConfig(_Config):
    top_k: int = 5
    return_properties: tuple[str, ...] | None = None


@dataclass(frozen=True)
class HybridExpansionConfig(HybridRetrieverConfig):
    """With a retrieval query that expands the hits."""


@dataclass(frozen=True)
class TextToQueryConfig(_Config):
    top_k: int = 0
    examples: tuple[str, ...] = ("USER INPUT: 'How many nodes are there?' QUERY: SELECT count(*) AS n FROM nodes",)


#: Indexers: ``influence`` ranks chunks by the communities found, ``global`` judges all communities of a degree,
#: ``community`` and ``chunk`` search summaries or chunks by vector, the last two index a property graph.
INDEXERS: dict[str, type[_Config]] = {
    "influence": ChunkingConfig,
    "global": ChunkingConfig,
    "community": ChunkingConfig,
    "chunk": ChunkingConfig,
    "graph_vector": VectorGraphIndexConfig,
    "graph_hybrid": HybridGraphIndexConfig,
    "template": TemplateIndexConfig,
}
RETRIEVERS: dict[str, type[_Config]] = {
    "influence": VectorRetrieverConfig,
    "global": GlobalRetrieverConfig,
    "community": VectorRetrieverConfig,
    "chunk": VectorRetrieverConfig,
    "graph_vector": GraphVectorRetrieverConfig,
    "graph_vector_expansion": GraphVectorExpansionConfig,
    "graph_hybrid": HybridRetrieverConfig,
    "graph_hybrid_expansion": HybridExpansionConfig,
    "text_to_query": TextToQueryConfig,
    "template": VectorRetrieverConfig,
}
_COMMUNITY = ("influence", "global", "community", "chunk")
_GRAPH = ("graph_vector", "graph_vector_expansion")
#: Pairs of indexer and retriever that work together; None where only one of them is used. 30 in all.
SUPPORTED: frozenset[tuple[str | None, str | None]] = frozenset(
    [(i, None) for i in (*_COMMUNITY, "graph_vector", "graph_hybrid")]
    + [(None, r) for r in (*_COMMUNITY, "text_to_query")]
    + [(i, r) for i in ("influence", "global", "community") for r in _COMMUNITY]
    + [("chunk", "chunk")]
    + [("graph_vector", r) for r in _GRAPH]
    + [("graph_hybrid", r) for r in (*_GRAPH, "graph_hybrid", "graph_hybrid_expansion")]
)
DEFAULT_PAIR = ("influence", "influence")
