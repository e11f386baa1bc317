"""Models behind narrow interfaces, with deterministic stand-ins.

The stand-ins are for tests and offline runs. They only have the shape of a model's answers and make no
claim to its quality. Providers are plain objects that are shipped to executors, so they must be picklable
and should load what they need on first use.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from skeinlake.functions import salvage, text as T


class Embedder(Protocol):
    dims: int

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class Extractor(Protocol):
    def extract(self, text: str) -> str:
        """Relations of a text as a JSON array of From, To, Relation."""


class Summarizer(Protocol):
    def summarize(self, text: str) -> str:
        """A JSON object with label and description."""


class Judge(Protocol):
    def judge(self, prompt: str, block: str) -> str:
        """A JSON object with information and confidence from 0 to 100."""


class Answerer(Protocol):
    def answer(self, prompt: str, context: list[str]) -> str: ...


class Translator(Protocol):
    def translate(self, prompt: str, schema: str, examples: tuple[str, ...]) -> str:
        """One SELECT statement over the given views."""


_WORD = re.compile(r"\w+")


class HashEmbedder:
    """Stand-in: signed hashed bag of words, of unit length."""

    def __init__(self, dims: int = 384):
        self.dims = dims

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dims
            for w in _WORD.findall((t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dims] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


class PatternExtractor:
    """Stand-in: ``Subject verb Object`` of capitalised names in a sentence."""

    _TRIPLE = re.compile(r"\b([A-Z]\w+(?: [A-Z]\w+)*) ([a-z]+(?: [a-z]+){0,3}) ([A-Z]\w+(?: [A-Z]\w+)*)")

    def extract(self, text: str) -> str:
        found = [{"From": a, "To": b, "Relation": r} for a, r, b in self._TRIPLE.findall(text or "")]
        return json.dumps(found, ensure_ascii=False)


class LeadSummarizer:
    """Stand-in: the first words as label, the first characters as description."""

    def summarize(self, text: str) -> str:
        words = (text or "").split()
        label = " ".join(words[:6]).strip(".,:;") or "empty"
        return json.dumps({"label": label.ljust(5, "_"), "description": " ".join(words)[:400].ljust(20, "_")}, ensure_ascii=False)


class OverlapJudge:
    """Stand-in: confidence is the share of the prompt's words that occur in the block."""

    def judge(self, prompt: str, block: str) -> str:
        asked = set(_WORD.findall(prompt.lower()))
        have = set(_WORD.findall(block.lower()))
        return json.dumps({"information": block, "confidence": round(100 * len(asked & have) / max(1, len(asked)))}, ensure_ascii=False)


class ContextAnswerer:
    """Stand-in: the context itself."""

    def answer(self, prompt: str, context: list[str]) -> str:
        return "\n".join(context)


def create_chat(prompt: str, system: str | None = None, history: list[dict] | None = None) -> list[dict]:
    """Messages of role and content: system, earlier turns, prompt."""
    head = [{"role": "system", "content": system}] if system else []
    return [*head, *prepare_history(history or []), {"role": "user", "content": prompt}]


def prepare_history(turns: list[dict]) -> list[dict]:
    """Earlier turns with known roles and some content; any other role speaks as the user."""
    known = {"system", "user", "assistant"}
    return [{"role": t.get("role") if t.get("role") in known else "user", "content": t["content"]} for t in turns if t.get("content")]


def embed(column: Column, embedder: Embedder) -> Column:
    """``array<float>`` of a text column, a batch at a time. Null texts have no vector."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            have = s.notna()
            vectors = iter(embedder.encode(s[have].tolist()) if have.any() else [])
            yield pd.Series([next(vectors) if h else None for h in have], index=s.index, dtype=object)

    return run(column)


def _asked(df: DataFrame, columns: list[str], out: str, ask, good, tries: int, fallback: str) -> DataFrame:
    """A model call for each row with bounded retries; rows keep their columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = []
            for args in pdf[columns].itertuples(index=False):
                answer = fallback
                for _ in range(tries):
                    try:
                        candidate = ask(*args)
                    except (ValueError, OSError, TimeoutError):
                        continue
                    if good(candidate):
                        answer = candidate
                        break
                answers.append(answer)
            yield pdf.assign(**{out: answers})

    return df.mapInPandas(run, df.withColumn(out, F.lit("")).schema)


def extract_relations(chunks: DataFrame, extractor: Extractor, tries: int = 8, text_col: str = "content") -> DataFrame:
    """Chunks with ``relations``; a chunk whose answers never hold a relation has an empty array."""
    good = lambda s: bool(salvage.salvage_relations(s))
    asked = _asked(chunks, [text_col], "__raw", extractor.extract, good, tries, "[]")
    return asked.withColumn("relations", salvage.relations_of(F.col("__raw"))).drop("__raw")


def _summary_good(answer: str) -> bool:
    try:
        d = json.loads(answer[answer.find("{") : answer.rfind("}") + 1])
        return len(str(d["label"])) >= 5 and len(str(d["description"])) >= 20
    except (ValueError, KeyError, TypeError):
        return '"label":' in answer and '"description":' in answer


def summarize(df: DataFrame, summarizer: Summarizer, text_col: str, tries: int = 5) -> DataFrame:
    """Rows with ``summary`` (struct of label and description); null where no try gave a usable one."""
    asked = _asked(df, [text_col], "__raw", summarizer.summarize, _summary_good, tries, "")
    return asked.withColumn("summary", T.salvage_summary(F.col("__raw"))).drop("__raw")


def _judgement_good(answer: str) -> bool:
    try:
        d = json.loads(answer[answer.find("{") : answer.rfind("}") + 1])
        return isinstance(d["information"], str) and 0 <= int(d["confidence"]) <= 100
    except (ValueError, KeyError, TypeError):
        return False


def judge_blocks(blocks: DataFrame, judge: Judge, prompt: str, text_col: str = "block", tries: int = 10) -> DataFrame:
    """Blocks with ``information`` and ``confidence``; one that never gets a proper answer has confidence 0."""
    fallback = '{"information": "", "confidence": 0}'
    asked = _asked(blocks, [text_col], "__raw", lambda b: judge.judge(prompt, b), _judgement_good, tries, fallback)
    parsed = F.from_json(T.json_bounds(F.col("__raw")), "struct<information:string,confidence:int>")
    return asked.withColumn("__p", parsed).select(*blocks.columns, F.col("__p.information").alias("information"), F.coalesce("__p.confidence", F.lit(0)).alias("confidence"))
