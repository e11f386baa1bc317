"""A model's SQL, checked before it runs: one SELECT over allowed views, nothing that writes or reads elsewhere."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from skeinlake.providers import Translator

_FORBIDDEN = re.compile(
    r"\b(insert|update|delete|merge|drop|alter|create|truncate|replace\s+table|set|reset|use|cache|uncache|refresh|add|load|grant|"
    r"revoke|analyze|explain|describe|show|call|execute|declare|msck|repair|java_method|reflect|try_reflect|transform\s*\()\b",
    re.IGNORECASE,
)
_FILE = re.compile(r"\b(?:parquet|json|csv|text|orc|avro|binaryfile|jdbc|delta)\s*\.\s*`", re.IGNORECASE)


def without_literals(sql: str) -> str:
    """Comments removed, string literals emptied."""
    out = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", sql)
    out = re.sub(r'"(?:[^"\\]|\\.)*"', "''", out)
    return re.sub(r"--[^\n]*|/\*.*?\*/", " ", out, flags=re.DOTALL)


def extract_sql(answer: str) -> str:
    """The statement in a model's answer: inside a code fence if there is one, without a closing semicolon."""
    fence = re.search(r"```(?:sql)?\s*(.*?)```", answer, re.DOTALL | re.IGNORECASE)
    return (fence.group(1) if fence else answer).strip().rstrip(";").strip()


def _relations(plan) -> set[str]:
    """Names of unresolved relations anywhere in a parsed plan, subqueries included, less its own CTE names."""
    text = plan.toString()
    names = set(re.findall(r"'?UnresolvedRelation \[([^\]]*)\]", text))
    return {n.split(",")[0].strip() if "," not in n else n.replace(", ", ".") for n in names}


def check_sql(spark: SparkSession, sql: str, views: set[str]) -> None:
    """Raise ValueError unless the statement is a single query that reads only ``views``."""
    plain = without_literals(sql)
    if ";" in plain:
        raise ValueError("more than one statement")
    if not re.match(r"\s*(select|with|\(|values)\b|\s*\(", plain, re.IGNORECASE):
        raise ValueError("not a query")
    if m := _FORBIDDEN.search(plain):
        raise ValueError(f"{m.group(1)} is not allowed")
    if _FILE.search(plain):
        raise ValueError("files may not be read")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    ctes = {n.lower() for n in re.findall(r"(?:\bwith\b|,)\s*`?(\w+)`?\s*(?:\([^)]*\))?\s+as\s*\(", plain, re.IGNORECASE)}
    # the names of common table expressions are known without their scope, so none may hide a table
    if hidden := {n for n in ctes if n in {v.lower() for v in views} or spark.catalog.tableExists(n)}:
        raise ValueError(f"{', '.join(sorted(hidden))} is a table's name")
    used = {n.lower() for n in _relations(plan)}
    if "unresolvedtablevaluedfunction" in plan.toString().lower():
        raise ValueError("table functions are not allowed")
    if stray := used - {v.lower() for v in views} - ctes:
        raise ValueError(f"unknown table {', '.join(sorted(stray))}")


def describe_views(spark: SparkSession, views: dict[str, DataFrame], hide: str = "Searchable") -> str:
    """Views and their columns as a model is told them; anything with the hidden word in its name is left out."""
    lines = []
    for name in sorted(views):
        if hide not in name:
            fields = ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in views[name].schema.fields if hide not in f.name)
            lines.append(f"{name}({fields})")
    return "\n".join(lines)


def text_to_query(spark: SparkSession, prompt: str, views: dict[str, DataFrame], translator: Translator, examples: tuple[str, ...] = ()) -> tuple[str, DataFrame]:
    """The checked statement and its result."""
    sql = extract_sql(translator.translate(prompt, describe_views(spark, views), examples))
    return sql, checked_query(spark, sql, views)


def checked_query(spark: SparkSession, sql: str, views: dict[str, DataFrame]) -> DataFrame:
    """Rows of a checked statement. The views have their names only while it is analysed; the session's own come back."""
    known = spark._jsparkSession.sessionState().catalog()
    before = {n: spark.table(n) for n in views if known.getTempView(n).isDefined()}
    for n in before:
        spark.catalog.dropTempView(n)
    try:
        check_sql(spark, sql, set(views))
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(sql)
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
        for name, df in before.items():
            df.createOrReplaceTempView(name)
