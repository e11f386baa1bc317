"""Relations out of model answers that should be JSON and often nearly are. Nothing is ever evaluated."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from skeinlake.functions.text import TRANSLITERATIONS

RELATIONS = "array<struct<From:string,To:string,Relation:string>>"
_KEYS = ("From", "To", "Relation")
_KEY = re.compile(r"[\"']?\b(From|To|Relation)\b[\"']?\s*:", re.IGNORECASE)
_OBJECT = re.compile(r"\{[^{}]*\}")


def _literal(text: str) -> object:
    for read in (json.loads, ast.literal_eval):
        try:
            return read(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
    return None


def _triple(item: object) -> dict | None:
    if not isinstance(item, dict):
        return None
    named = {str(k).capitalize(): v for k, v in item.items()}
    if not all(k in named and isinstance(named[k], (str, int, float)) for k in _KEYS):
        return None
    return {k: str(named[k]) for k in _KEYS}


def _by_keys(text: str) -> list[dict]:
    """Values after each key name, a new triple where a key comes again; quotes and brackets around them go."""
    marks = list(_KEY.finditer(text))
    out: list[dict] = []
    now: dict = {}
    for m, after in zip(marks, [*marks[1:], None]):
        key = m.group(1).capitalize()
        value = text[m.end() : after.start() if after else len(text)].strip(" \t\r\n,;{}[]\"'")
        if key in now:
            now = {}
        now[key] = value
        if len(now) == 3:
            out.append(now)
            now = {}
    return out


def salvage_relations(text: str | None) -> list[dict]:
    """Triples of an answer: the whole as JSON, else object by object, else by key names."""
    if not text:
        return []
    for a, b in TRANSLITERATIONS:
        text = text.replace(a, b)
    begin, end = text.find("["), text.rfind("]")
    whole = _literal(text[begin : end + 1]) if 0 <= begin < end else None
    if isinstance(whole, list):
        return [t for t in map(_triple, whole) if t]
    pieces = _OBJECT.findall(text)
    if pieces:
        out: list[dict] = []
        for p in pieces:
            t = _triple(_literal(p)) if len(_KEY.findall(p)) == 3 else None
            out += [t] if t else _by_keys(p)
        return out
    return _by_keys(text)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in _KEYS])))
def _salvaged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(salvage_relations)


def relations_of(raw: Column) -> Column:
    """``array<struct<From,To,Relation>>``: parsed in the JVM where the answer is proper JSON, salvaged else."""
    text = raw
    for a, b in TRANSLITERATIONS:
        text = F.replace(text, F.lit(a), F.lit(b))
    proper = F.from_json(text, RELATIONS, {"mode": "PERMISSIVE"})
    whole = proper.isNotNull() & F.forall(
        proper, lambda t: t["From"].isNotNull() & t["To"].isNotNull() & t["Relation"].isNotNull()
    )
    return F.when(F.coalesce(whole, F.lit(False)), proper).otherwise(_salvaged(raw))
