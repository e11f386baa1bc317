"""Registered queries of text functions, chunking, tables and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlake.functions import salvage, text as T
from skeinlake.operators import chunking, filters, ranking, text_to_query as t2q
from skeinlake.sources import tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    clean = T.clean_text(F.col("text"))
    return docs.select("doc_id", F.md5(clean.cast("binary")).alias("digest"), F.length(clean).alias("chars"))


def canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    key = T.canonical_key(T.transliterate(F.col("text")))
    return docs.select("doc_id", F.md5(key.cast("binary")).alias("digest"))


def entity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = T.canonical_key(T.transliterate(F.concat("p_name", F.lit(" & "), "p_brand")))
    part = _table(spark, sf_dir, "part").select("p_partkey", key.alias("key"))
    typed = F.concat(F.lit("Part/"), "key")
    return part.select("p_partkey", "key", T.display_label(F.col("key")).alias("label"), T.type_of_id(typed).alias("kind"))


def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("section_no", "section"))
    return rows.select("doc_id", "section_no", F.md5(F.col("section").cast("binary")).alias("digest"), F.length("section").alias("chars"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    pages = docs.select("doc_id", F.array(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("pages"))
    chunks = chunking.chunk_documents(pages, 1024)
    return chunks.select("doc_id", "chunk_no", F.md5(F.col("body").cast("binary")).alias("digest"), F.length("body").alias("chars"), "page_hint")


def chunk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    h1 = F.when(F.length(first) <= 60, first)
    file = F.concat("source", F.lit(".txt"))
    content = T.render_chunk(h1, F.col("lang"), F.lit(""), F.col("source"))
    return docs.select("doc_id", T.chunk_label(file, h1).alias("label"), content.alias("content"), T.content_block(file, F.col("lang")).alias("block"))


def page_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set(F.col("turn").cast("int"))).alias("ref"))
    return conv.select("conv_id", T.page_hint(F.col("ref")).alias("hint"))


def manifest_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return tables.unseen(docs, _table(spark, sf_dir, "labels"), ("doc_id",))


def conversation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.struct("turn", F.concat("role", F.lit(": "), "text").alias("said"))
    grouped = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(turn)).alias("all"))
    thread = F.array_join(F.transform("all", lambda t: t["said"]), "\n")
    return grouped.select("conv_id", "turns", F.md5(thread.cast("binary")).alias("digest"))


def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    proper = F.concat(F.lit('[{"From": "'), "n_name", F.lit('", "To": "'), "r_name", F.lit('", "Relation": "lies in"}]'))
    broken = F.concat(F.lit("Sure: {From: "), "n_name", F.lit(', "To": '), "r_name", F.lit(', "Relation": "lies in"} and so on'))
    raw = nation.select(F.col("n_nationkey").alias("chunk_id"), F.when(F.col("n_nationkey") % 2 == 0, proper).otherwise(broken).alias("raw"))
    rows = raw.select("chunk_id", F.explode(salvage.relations_of(F.col("raw"))).alias("t"))
    return rows.select("chunk_id", F.col("t.From").alias("src"), F.col("t.To").alias("dst"), F.col("t.Relation").alias("label"))


def summary_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = _table(spark, sf_dir, "region")
    answer = F.concat(F.lit('Here: {"label": "Region '), "r_name", F.lit('", "description": "All the nations that lie in '), "r_name", F.lit('."} done'))
    rows = region.select("r_regionkey", T.salvage_summary(answer).alias("s"))
    return rows.select("r_regionkey", F.col("s.label").alias("label"), F.col("s.description").alias("description"))


def node_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment", F.lit("nation"), F.col("c_nationkey").cast("string"))
    return _table(spark, sf_dir, "customer").select("c_custkey", T.node_text(F.array(F.lit("Customer"), F.lit("Party")), props).alias("content"))


def graph_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer").select(
        F.array(F.lit("Customer"), F.lit("Searchable")).alias("labels"), F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment").alias("props")
    )
    supplier = _table(spark, sf_dir, "supplier").select(F.array(F.lit("Supplier")).alias("labels"), F.create_map(F.lit("name"), "s_name").alias("props"))
    return tables.structured_schema(tables.union_all(customer, supplier))


def all_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = _table(spark, sf_dir, "region").select(F.concat(F.lit("Region/"), "r_regionkey").alias("id"), F.col("r_name").alias("label"))
    nation = _table(spark, sf_dir, "nation").select(F.concat(F.lit("Nation/"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), "n_regionkey")
    return tables.union_all(region, nation).withColumn("kind", T.type_of_id(F.col("id")))


def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    rule = {"p_size": {"$between": [5, 30]}, "$or": [{"p_brand": {"$ilike": "brand#1"}}, {"p_retailprice": {"$gt": 1500}}], "p_type": {"$nin": ["STEEL", "TIN"]}}
    return part.where(filters.compile_filter(rule, part.columns)).select("p_partkey", "p_brand", "p_size")


class _Fixed:
    """A translator that always gives the same answer; it stands for a model."""

    def translate(self, prompt: str, schema: str, examples: tuple[str, ...]) -> str:
        return (
            "```sql\nSELECT n.n_name AS nation, count(*) AS customers, round(sum(c.c_acctbal), 2) AS balance\n"
            "FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name;\n```"
        )


def text_to_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = {n: _table(spark, sf_dir, n) for n in ("customer", "nation")}
    return t2q.text_to_query(spark, "How many customers has each nation?", views, _Fixed())[1]


def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    drawn = ranking.weighted_order(docs, "doc_id", "n_chars", "17")
    return drawn.orderBy("draw", "doc_id").limit(50).select("doc_id", "n_chars", F.round(F.col("draw") * 1e6, 4).alias("draw"))


def community_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation")
    return nation.select("n_nationkey", T.community_key(F.col("n_regionkey"), F.col("n_nationkey")).alias("community_key"))


_FUNCTIONS = (
    text_cleanup, canonical_key, entity_labels, chunk_sections, chunk_documents, chunk_labels, page_hints, manifest_antijoin,
    conversation_threads, json_salvage, summary_salvage, node_text, graph_schema, all_vertices, metadata_filter, text_to_query,
    weighted_sample, community_keys,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}


def _key(expr: str) -> str:
    """Transliteration and canonical key in SQL."""
    for a, b in T.TRANSLITERATIONS:
        expr = f"replace({expr}, '{a}', '{b}')"
    return f"regexp_replace(replace({expr}, ' ', '_'), '{T.NOT_KEY}', '', 'g')"


_CLEAN = "text"
for _pattern, _to in ((r"\.\.\.+", "..."), (" +", " "), ("\n ", "\n"), ("\n+", "\n")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_pattern}', '{_to}', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '^[ \\t\\n\\r\\x0b\\x0c]+|[ \\t\\n\\r\\x0b\\x0c]+$', '', 'g')"

SQL = {
    "text_cleanup": f"SELECT doc_id, md5({_CLEAN}) AS digest, length({_CLEAN})::INT AS chars FROM documents",
    "canonical_key": f"SELECT doc_id, md5({_key('text')}) AS digest FROM documents",
    "entity_labels": f"""
        SELECT p_partkey, key, replace(key, '_', ' ') AS label, split_part('Part/' || key, '/', 1) AS kind
        FROM (SELECT p_partkey, {_key("p_name || ' & ' || p_brand")} AS key FROM part)
    """,
    "chunk_sections": """
        SELECT doc_id, (i - 1)::INT AS section_no, md5(parts[i]) AS digest, length(parts[i])::INT AS chars
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, unnest(generate_series(1, len(parts))) AS u(i)
    """,
    "chunk_documents": """
        WITH RECURSIVE d AS (
            SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
        ), f AS (
            SELECT doc_id, parts, 1 AS i, 0 AS chunk_no, parts[1] AS body, length(parts[1]) AS size FROM d
            UNION ALL
            SELECT doc_id, parts, i + 1,
                   CASE WHEN size + length(parts[i + 1]) > 1024 THEN chunk_no + 1 ELSE chunk_no END,
                   CASE WHEN size + length(parts[i + 1]) > 1024 THEN parts[i + 1] ELSE body || chr(10) || chr(10) || parts[i + 1] END,
                   CASE WHEN size + length(parts[i + 1]) > 1024 THEN length(parts[i + 1]) ELSE size + 2 + length(parts[i + 1]) END
            FROM f WHERE i < len(parts)
        ), last AS (SELECT doc_id, chunk_no, max_by(body, i) AS body FROM f GROUP BY doc_id, chunk_no)
        SELECT doc_id, chunk_no::INT AS chunk_no, md5(body) AS digest, length(body)::INT AS chars, 'Page (1)' AS page_hint FROM last
    """,
    "chunk_labels": """
        SELECT doc_id,
               CASE WHEN coalesce(h1, '') <> '' THEN replace(source || '.txt - ' || h1, '*', '') ELSE source || '.txt' END AS label,
               CASE WHEN coalesce(h1, '') <> '' THEN '# ' || h1 || chr(10) || chr(10) ELSE '' END || '## ' || lang || chr(10) || chr(10) || source AS content,
               source || '.txt: ' || lang || chr(10) AS block
        FROM (SELECT *, CASE WHEN length(split_part(text, chr(10), 1)) <= 60 THEN split_part(text, chr(10), 1) END AS h1 FROM documents)
    """,
    "page_hints": """
        SELECT conv_id, CASE WHEN min(turn) = max(turn) THEN 'Page (' || (min(turn) + 1) || ')'
                             ELSE 'Pages (' || (min(turn) + 1) || '-' || (max(turn) + 1) || ')' END AS hint
        FROM conversations GROUP BY conv_id
    """,
    "manifest_antijoin": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "conversation_threads": """
        SELECT conv_id, count(*) AS turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id
    """,
    "json_salvage": """
        SELECT n_nationkey AS chunk_id, n_name AS src, r_name AS dst, 'lies in' AS label FROM nation JOIN region ON n_regionkey = r_regionkey
    """,
    "summary_salvage": """
        SELECT r_regionkey, 'Region ' || r_name AS label, 'All the nations that lie in ' || r_name || '.' AS description FROM region
    """,
    "node_text": """
        SELECT c_custkey, 'label: Customer, Party ; name: ' || c_name || ' ; nation: ' || c_nationkey || ' ; segment: ' || c_mktsegment AS content FROM customer
    """,
    "graph_schema": """
        SELECT 'Customer' AS label, 'name' AS property, count(*) AS n FROM customer UNION ALL
        SELECT 'Customer', 'segment', count(*) FROM customer UNION ALL SELECT 'Supplier', 'name', count(*) FROM supplier
    """,
    "all_vertices": """
        SELECT 'Region/' || r_regionkey AS id, r_name AS label, NULL::INT AS n_regionkey, 'Region' AS kind FROM region UNION ALL
        SELECT 'Nation/' || n_nationkey, n_name, n_regionkey, 'Nation' FROM nation
    """,
    "metadata_filter": """
        SELECT p_partkey, p_brand, p_size FROM part
        WHERE p_size BETWEEN 5 AND 30 AND (lower(p_brand) LIKE '%brand#1%' OR p_retailprice > 1500) AND p_type NOT IN ('STEEL', 'TIN')
    """,
    "text_to_query": """
        SELECT n_name AS nation, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
    """,
    "weighted_sample": """
        SELECT doc_id, n_chars, round(draw * 1e6, 4) AS draw FROM (
            SELECT doc_id, n_chars,
                   -ln((('0x' || substr(md5('17/' || doc_id), 1, 13))::BIGINT::DOUBLE + 1) / (4503599627370496::DOUBLE + 1)) / n_chars AS draw
            FROM documents WHERE n_chars > 0)
        ORDER BY draw, doc_id LIMIT 50
    """,
    "community_keys": "SELECT n_nationkey, printf('%05d/%05d', n_regionkey, n_nationkey) AS community_key FROM nation",
}
