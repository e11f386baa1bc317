"""Registered queries of the graph operators, with their SQL. The graph is drawn from the order tables: customers and
parts are entities, an order is the chunk that mentions them, its status is the relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from skeinlake.operators import communities as C, graph as G, leiden, similarity
from skeinlake.storage import parts_for


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitioned by chunk, a bounded number of lines each: what goes by chunk needs no further exchange."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = parts_for(lines)
    lines = lines.repartition(parts, "l_orderkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").repartition(parts, "o_orderkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    one = F.struct(
        F.concat(F.lit("Customer "), "o_custkey").alias("From"), F.concat(F.lit("Part "), "l_partkey").alias("To"), F.col("o_orderstatus").alias("Relation")
    )
    return G.valid_triples(rows.select(F.col("o_orderkey").alias("chunk_id"), F.array(one).alias("relations")))


def triples_to_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.relation_weights(_triples(spark, sf_dir))


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.entity_mentions(_triples(spark, sf_dir))


def entity_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = G.entity_weights(G.entity_mentions(_triples(spark, sf_dir)))
    return w.select("entity", F.round("weight", 6).alias("weight"))


def provenance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("source"))
    return G.rollup_provenance(G.entity_mentions(_triples(spark, sf_dir)), keys, "source")


def mention_edges_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mention_edges_full(G.entity_mentions(_triples(spark, sf_dir)))


def mention_edges_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = _triples(spark, sf_dir)
    return G.mention_edges_sparse(G.relation_weights(triples), G.entity_mentions(triples))


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers with the number of lines between them."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    both = rows.select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"))
    return both.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("vertex"), F.col("c_nationkey").alias("community"))
    supplier = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("vertex"), F.col("s_nationkey").alias("community"))
    return customer.unionByName(supplier)


def graph_contraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.contract(_trade(spark, sf_dir), _nations(spark, sf_dir))


def cpm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = G.cpm_quality(_trade(spark, sf_dir), _nations(spark, sf_dir), 0.05)
    return q.select("community", "size", "inner_weight", F.round("quality", 6).alias("quality"))


def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    a = lines.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit(1.0).alias("weight"))
    b = lines.select(F.col("l_partkey").alias("src"), F.col("l_linenumber").alias("dst"), F.lit(2.0).alias("weight"))
    return G.undirected(a, b)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select(F.concat(F.lit("R"), "n_regionkey").alias("src"), F.concat(F.lit("N"), "n_nationkey").alias("dst"))
    supplier = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("src"), F.concat(F.lit("S"), "s_suppkey").alias("dst"))
    return nation.unionByName(supplier)


def khop_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("vertex"))
    return G.khop(_places(spark, sf_dir), seeds, 3)


def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("vertex"))
    return G.neighbours(_places(spark, sf_dir), seeds)


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.connected_components(_places(spark, sf_dir))


def node_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = _table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("vertex"), F.col("r_name").alias("label"))
    nation = _table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("vertex"), F.col("n_name").alias("label"), F.concat(F.lit("R"), "n_regionkey").alias("r"))
    relations = nation.select(F.col("vertex").alias("src"), F.col("r").alias("dst"), F.lit("lies in").alias("label"))
    return G.node_description(relations, region.unionByName(nation.drop("r")))


def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in one root, regions and nations, as (vertex, level, community)."""
    s = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    vertex = F.format_string("S%06d", "s_suppkey")
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.lit("root").alias("community")),
        F.struct(F.lit(1).alias("level"), F.format_string("R%03d", "n_regionkey").alias("community")),
        F.struct(F.lit(2).alias("level"), F.format_string("N%03d", "n_nationkey").alias("community")),
    )
    rows = s.select(vertex.alias("vertex"), F.explode(levels).alias("x"))
    return rows.select("vertex", "x.level", "x.community")


def community_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.community_tables(_hierarchy(spark, sf_dir))
    return m.groupBy("level", "idx", "community_key", "community").agg(F.count("*").alias("members"))


def vertex_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = C.vertex_communities(C.community_tables(_hierarchy(spark, sf_dir)))
    return v.select("vertex", F.array_join(F.transform("communities", lambda x: x.cast("string")), "/").alias("path"))


def _shared_parts(spark: SparkSession, sf_dir: str, members: DataFrame) -> DataFrame:
    """Edges of communities of suppliers, who are linked by the parts that both deliver."""
    lines = _table(spark, sf_dir, "lineitem").where("l_suppkey IS NOT NULL")
    held = lines.select(F.format_string("S%06d", "l_suppkey").alias("vertex"), F.col("l_partkey").alias("item"))
    return C.shared_community_edges(members, held, parts_for(lines))


def two_level_edge_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared_parts(spark, sf_dir, C.community_tables(_hierarchy(spark, sf_dir)).where("level <= 2"))


def two_level_edge_weight_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``two_level_edge_weight``, down to the single suppliers."""
    return _shared_parts(spark, sf_dir, C.community_tables(_hierarchy(spark, sf_dir)))


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line once; the roll-up adds them up."""
    lines = _table(spark, sf_dir, "lineitem")
    return lines.select(F.format_string("S%06d", "l_suppkey").alias("entity"), F.col("l_orderkey").alias("chunk_id"), F.lit(1).cast("bigint").alias("cnt"))


def community_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rollup(C.community_tables(_hierarchy(spark, sf_dir)).where("level <= 1"), _deliveries(spark, sf_dir), "chunk_id")


def community_rollup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``community_rollup``, with the communities of all levels."""
    return C.rollup(C.community_tables(_hierarchy(spark, sf_dir)), _deliveries(spark, sf_dir), "chunk_id")


def _near(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """Each vector's ``k`` nearest others of the whole table by Euclidean distance, exactly; ties go to the smaller id."""
    hits = similarity.vector_topk_all(_table(spark, sf_dir, "embeddings"), k + 1).where("query_id <> vec_id")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    name = lambda c: F.concat(F.lit("E"), F.format_string("%08d", c))
    rows = hits.withColumn("place", place).where(F.col("place") <= k)
    return rows.select(name("query_id").alias("src"), name("vec_id").alias("dst"), F.lit(1.0).alias("weight"))


def leiden_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of Leiden communities of the graph of near vectors: each is joined to its three nearest, whatever their labels."""
    return leiden.leiden_communities(_near(spark, sf_dir)).groupBy("level", "community").agg(F.count("*").alias("size"))


_FUNCTIONS = (
    triples_to_edges, entity_mentions, entity_weight, provenance_rollup, mention_edges_full, mention_edges_sparse, graph_contraction, cpm_quality,
    undirected_edges, khop_reach, graph_neighbours, connected_components, node_description, community_tables, vertex_communities, two_level_edge_weight,
    two_level_edge_weight_all, community_rollup, community_rollup_all, leiden_hierarchy,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_TRIPLES = """
    t AS (SELECT l_orderkey AS chunk_id, 'Customer_' || o_custkey AS src, 'Part_' || l_partkey AS dst, o_orderstatus AS label
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> ''),
    m AS (SELECT entity, chunk_id, count(*) AS cnt
          FROM (SELECT chunk_id, src AS entity FROM t UNION ALL SELECT chunk_id, dst FROM t) GROUP BY entity, chunk_id)
"""
_TRADE = """
    e AS (SELECT 'C' || o_custkey AS src, 'S' || l_suppkey AS dst, count(*)::DOUBLE AS weight
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    v AS (SELECT 'C' || c_custkey AS vertex, c_nationkey AS community FROM customer UNION ALL SELECT 'S' || s_suppkey, s_nationkey FROM supplier)
"""
_PLACES = """
    p AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier),
    b AS (SELECT src, dst FROM p UNION SELECT dst, src FROM p)
"""
_HIERARCHY = """
    h AS (SELECT printf('S%06d', s_suppkey) AS vertex, level, CASE level WHEN 0 THEN 'root' WHEN 1 THEN printf('R%03d', n_regionkey)
                 WHEN 2 THEN printf('N%03d', n_nationkey) ELSE printf('S%06d', s_suppkey) END AS community
          FROM supplier JOIN nation ON s_nationkey = n_nationkey, (SELECT unnest([0, 1, 2, 3]) AS level)),
    k AS (SELECT vertex, level, community, (dense_rank() OVER (PARTITION BY level ORDER BY community) - 1)::BIGINT AS idx FROM h),
    c AS (SELECT *, printf('%05d/%05d', level, idx) AS community_key FROM k)
"""
SQL = {
    "triples_to_edges": f"WITH {_TRIPLES} SELECT src, dst, label, count(*) AS weight FROM t GROUP BY src, dst, label",
    "entity_mentions": f"WITH {_TRIPLES} SELECT entity, chunk_id, cnt FROM m",
    "entity_weight": f"""
        WITH {_TRIPLES} SELECT entity, round(sum(cnt / total), 6) AS weight
        FROM (SELECT entity, cnt::DOUBLE AS cnt, sum(cnt) OVER (PARTITION BY chunk_id) AS total FROM m) GROUP BY entity
    """,
    "provenance_rollup": f"""
        WITH {_TRIPLES} SELECT entity, o_orderpriority AS source, sum(cnt)::BIGINT AS cnt FROM m JOIN orders ON chunk_id = o_orderkey GROUP BY 1, 2
    """,
    "mention_edges_full": f"WITH {_TRIPLES} SELECT entity, chunk_id, cnt AS weight FROM m",
    "graph_contraction": f"""
        WITH {_TRADE} SELECT a.community AS src, b.community AS dst, sum(weight) AS weight
        FROM e JOIN v a ON a.vertex = src JOIN v b ON b.vertex = dst GROUP BY 1, 2
    """,
    "cpm_quality": f"""
        WITH {_TRADE}, i AS (SELECT a.community, sum(weight) AS w FROM e JOIN v a ON a.vertex = src JOIN v b ON b.vertex = dst
                             WHERE a.community = b.community GROUP BY 1),
        s AS (SELECT community, count(*) AS size FROM v GROUP BY 1)
        SELECT community, size, coalesce(w, 0.0)::DOUBLE AS inner_weight, round(coalesce(w, 0.0) - 0.05 * size * (size - 1) / 2, 6) AS quality
        FROM s LEFT JOIN i USING (community)
    """,
    "undirected_edges": """
        WITH e AS (SELECT l_suppkey::VARCHAR AS src, l_partkey::VARCHAR AS dst, 1.0::DOUBLE AS weight FROM lineitem UNION ALL
                   SELECT l_partkey::VARCHAR, l_linenumber::VARCHAR, 2.0 FROM lineitem)
        SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM e UNION ALL SELECT dst, src, weight FROM e WHERE src <> dst) GROUP BY src, dst
    """,
    "khop_reach": f"""
        WITH RECURSIVE {_PLACES}, r AS (
            SELECT 'N' || n_nationkey AS seed, 'N' || n_nationkey AS vertex, 0 AS hops FROM nation
            UNION SELECT seed, dst, hops + 1 FROM r JOIN b ON vertex = src WHERE hops < 3)
        SELECT seed, vertex, min(hops)::INT AS hops FROM r GROUP BY seed, vertex HAVING min(hops) > 0
    """,
    "graph_neighbours": f"WITH {_PLACES} SELECT DISTINCT src AS seed, dst AS vertex FROM b WHERE src LIKE 'N%'",
    "connected_components": f"""
        WITH RECURSIVE {_PLACES}, r AS (SELECT src AS vertex, src AS other FROM b UNION SELECT r.vertex, b.dst FROM r JOIN b ON r.other = b.src)
        SELECT vertex, min(other) AS component FROM r GROUP BY vertex
    """,
    "node_description": """
        WITH g AS (SELECT r_regionkey, r_name, n_name, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) - 1) // 5 AS part
                   FROM region LEFT JOIN nation ON n_regionkey = r_regionkey),
        s AS (SELECT r_regionkey, r_name, part, string_agg(n_name, ', ' ORDER BY n_name) || ' have relation ''lies in'' with ' || r_name || '.' AS s
              FROM g WHERE n_name IS NOT NULL GROUP BY 1, 2, 3)
        SELECT 'R' || r_regionkey AS vertex, coalesce((SELECT string_agg(s, ' ' ORDER BY part) FROM s WHERE s.r_regionkey = region.r_regionkey), r_name || '.') AS description
        FROM region
        UNION ALL SELECT 'N' || n_nationkey, n_name || ' has relation ''lies in'' with ' || r_name || '.' FROM nation JOIN region ON n_regionkey = r_regionkey
    """,
    "community_tables": f"WITH {_HIERARCHY} SELECT level::INT AS level, idx, community_key, community, count(*) AS members FROM c GROUP BY 1, 2, 3, 4",
    "vertex_communities": f"WITH {_HIERARCHY} SELECT vertex, string_agg(idx::VARCHAR, '/' ORDER BY level) AS path FROM c GROUP BY vertex",
    "two_level_edge_weight": f"""
        WITH {_HIERARCHY}, q AS (SELECT DISTINCT l_partkey, printf('S%06d', l_suppkey) AS v FROM lineitem),
        e AS (SELECT a.v AS src, b.v AS dst, count(*)::DOUBLE AS weight FROM q a JOIN q b USING (l_partkey) WHERE a.v <> b.v GROUP BY 1, 2),
        l AS (SELECT DISTINCT p.community_key AS parent_key, x.community_key AS child_key FROM c p JOIN c x ON x.vertex = p.vertex AND x.level = p.level + 1 AND x.level <= 2),
        n AS (SELECT community_key, count(*) AS n FROM c GROUP BY 1),
        w AS (SELECT l.parent_key, l.child_key, sum(weight) AS w FROM l JOIN c x ON x.community_key = l.child_key JOIN e ON e.dst = x.vertex
              JOIN c p ON p.community_key = l.parent_key AND p.vertex = e.src
              WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.community_key = l.child_key AND y.vertex = e.src) GROUP BY 1, 2)
        SELECT l.parent_key, l.child_key, CASE WHEN a.n = b.n THEN 1.0 ELSE coalesce(w, 0.0) END::DOUBLE AS weight
        FROM l JOIN n a ON a.community_key = l.parent_key JOIN n b ON b.community_key = l.child_key LEFT JOIN w ON w.parent_key = l.parent_key AND w.child_key = l.child_key
    """,
    "community_rollup": f"""
        WITH {_HIERARCHY} SELECT community_key, l_orderkey AS chunk_id, count(*) AS cnt
        FROM lineitem JOIN c ON vertex = printf('S%06d', l_suppkey) WHERE level <= 1 GROUP BY 1, 2
    """,
}
#: The same without the limits of level.
SQL["two_level_edge_weight_all"] = SQL["two_level_edge_weight"].replace(" AND x.level <= 2", "")
SQL["community_rollup_all"] = SQL["community_rollup"].replace(" WHERE level <= 1", "")
