"""Full-text index as plain tables, ranked with BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlake.functions import text as T
from skeinlake.storage import cut

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(term, id, tf, length) of the given string columns together; null texts hold no terms."""
    words = T.tokens(F.concat_ws(" ", *(F.col(c).cast("string") for c in text_cols)))
    rows = docs.select(F.col(id_col).alias("id"), words.alias("w")).where(F.size("w") > 0)
    terms = rows.select("id", F.size("w").alias("length"), F.explode("w").alias("term"))
    return terms.groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def search(index: DataFrame, query: str, k: int, n_docs: DataFrame | None = None) -> DataFrame:
    """(id, score) of the best ``k`` for a query, by BM25. Only the query's terms are read of the index.

    Idf is ``ln(1 + (N - df + 0.5) / (df + 0.5))``; N and the mean length come from the whole index, or from ``n_docs``
    (n, mean_length) where they are kept beside it. Ties go to the smaller id.
    """
    asked = terms_of(index.sparkSession, query)
    if n_docs is None:
        n_docs = corpus_stats(index)
    hits = index.where(F.col("term").isin(asked)) if asked else index.where(F.lit(False))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean_length"))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    joined = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(n_docs))  # as many rows as the query has terms, and one
    return joined.groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def terms_of(spark: SparkSession, query: str) -> list[str]:
    return sorted(set(spark.range(1).select(T.tokens(F.lit(query)).alias("w")).first()["w"]))


def search_texts(docs: DataFrame, id_col: str, text_cols: list[str], query: str, k: int) -> DataFrame:
    """(id, score) of the best ``k`` of a table without an index, by the same BM25, each row a document.

    One scan finds each document's length and counts of the query's terms, which are kept; statistics and scores read only those.
    Nothing is shuffled but sums and top lists.
    """
    asked = terms_of(docs.sparkSession, query)
    words = T.tokens(F.concat_ws(" ", *(F.col(c).cast("string") for c in text_cols)))
    rows = docs.select(F.col(id_col).alias("id"), words.alias("w"))
    hits = F.filter("w", lambda x: x.isin(asked)) if asked else F.array().cast("array<string>")
    rows = rows.select("id", F.size("w").alias("length"), hits.alias("h"))
    count = lambda t: F.size(F.filter("h", lambda x: x == F.lit(t)))
    rows = cut(rows.select("id", "length", *(count(t).alias(f"t{i}") for i, t in enumerate(asked)))).where("length > 0")
    found = [F.count_if(F.col(f"t{i}") > 0).alias(f"df{i}") for i in range(len(asked))]
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"), *found)
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean_length"))
    score, some = F.lit(0.0), F.lit(False)
    for i in range(len(asked)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + norm)
        some = some | (F.col(f"t{i}") > 0)
    hits = rows.where(some).crossJoin(F.broadcast(stats))  # one row
    return hits.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def corpus_stats(index: DataFrame) -> DataFrame:
    """(n, mean_length) of the indexed documents; one row."""
    return index.select("id", "length").distinct().agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))


def text_properties(schema: dict[str, list[tuple[str, str]]], target: list[str] | None, limit: int) -> list[tuple[str, str]]:
    """(label, property) of string properties to index: of the target labels or all, the first ``limit`` in order."""
    chosen = [(label, name) for label in sorted(schema) if target is None or label in target for name, kind in sorted(schema[label]) if kind.upper() == "STRING"]
    return chosen[:limit]
