"""Operator 7: token counts as rollups maintained by deltas.

Changes are signed rows: +1 for an inserted text, -1 for a deleted one, both for a revised one. A batch of changes is
reduced to additive totals by source, language and tokenizer version. Its files are written first; then a marker named
after the batch is created, which fails if there is one, so a batch counts once, whoever sends it again after
a crash or by mistake, and on any store that can create a file exclusively. Totals are those of the last base and
the commits after it; a base takes up all commits before it with their names, so that reading and
storage don't grow with history.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlake.llm import arrays as A
from skeinlake.llm import jobs

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens: English contractions, letters, digits, other signs and white space, each with a leading space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s+"
#: Runs of white space that would exceed the stack of the matcher.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0  -     　]{2000,}")
ROLLUP = "source string, lang string, tokenizer string, docs bigint, tokens bigint, chars bigint"
COUNTS = "source string, lang string, sign int, tokens bigint, chars bigint"
#: Commits after which a new base is made.
FOLD_EVERY = 16
_loaded: dict[str, object] = {}


def encoding(path: str):
    """The byte-pair encoding of a rank file, loaded once a worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("rollup", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_count(path: str, text: str) -> int:
    """Tokens of a text. Very long runs of white space, but for the last character before a word, are encoded on
    their own, which is how they are split anyway."""
    encode = encoding(path).encode_ordinary
    if len(text) <= 2000:
        return len(encode(text))
    at = total = 0
    for m in _LONG_SPACE.finditer(text):
        end = m.end() - (m.end() < len(text))
        total += len(encode(text[at : m.start()])) + len(encode(text[m.start() : end]))
        at = end
    return total + len(encode(text[at:]))


def with_counts(changes: DataFrame, ranks: str, text_col: str, source_col: str, lang_col: str, sign_col: str | None) -> DataFrame:
    """(source, lang, sign, tokens, chars) of each change; a null text counts nothing."""
    sign = F.col(sign_col).cast("int") if sign_col else F.lit(1)
    rows = changes.select(
        F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"),
        F.coalesce(sign, F.lit(0)).alias("sign"), F.col(text_col).cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in A.slices(batch.column(3)):
                texts = part.to_pylist()
                tokens = pa.array([token_count(ranks, t) for t in texts], pa.int64())
                chars = pa.array([len(t) for t in texts], pa.int64())
                rest = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([*rest.columns[:3], tokens, chars], names=["source", "lang", "sign", "tokens", "chars"])

    return rows.mapInArrow(run, COUNTS)


class TokenRollup:
    """Committed deltas and a base in a folder of shared storage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _create(self, name: str, content: str) -> bool:
        """A small file of that name; False if there is one."""
        try:
            out = self._fs.create(self._path(f"{self.folder}/{name}"), False)
        except Exception:  # the file system's error for a file that exists; any other one is raised again
            if self._fs.exists(self._path(f"{self.folder}/{name}")):
                return False
            raise
        out.write(bytearray(content.encode()))
        out.close()
        return True

    def _markers(self, kind: str) -> dict[str, str]:
        """Name to content of the markers of a kind. A marker whose writer died before it wrote is none."""
        found = self._fs.globStatus(self._path(f"{self.folder}/{kind}-*")) or []
        paths = [s.getPath().toString() for s in found if s.getLen() > 0]
        rows = self.spark.read.text(paths, wholetext=True).select("value", F.input_file_name().alias("path")).collect() if paths else []
        return {r.path.rsplit("/", 1)[1][len(kind) + 1 :]: r.value for r in rows}

    def _base(self) -> tuple[int, str | None]:
        bases = {int(k): v for k, v in self._markers("base").items()}
        return (max(bases), bases[max(bases)]) if bases else (0, None)

    def committed(self, batch: str) -> bool:
        marker = self._path(f"{self.folder}/commit-{self._named(batch)}")
        if self._fs.exists(marker) and self._fs.getFileStatus(marker).getLen() > 0:
            return True
        base = self._base()[1]
        return base is not None and not self.spark.read.parquet(f"{self.folder}/{base}/batches").where(F.col("batch") == batch).isEmpty()

    @staticmethod
    def _named(batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError(f"batch id {batch!r} isn't made of letters, digits, '.', '_' and '-'")
        return batch

    def commit(
        self,
        batch: str,
        changes: DataFrame,
        tokenizer: str,
        ranks: str = RANKS,
        text_col: str = "text",
        source_col: str = "source",
        lang_col: str = "lang",
        sign_col: str | None = "sign",
    ) -> bool:
        """Apply a batch of signed texts. False if it is committed already; then nothing is counted again.

        A sign is a number of texts, below zero where they are deleted; a null one counts nothing, as does an empty batch.
        Totals are additive: a delete of what was never inserted shows as a negative count. Null sources and languages
        are kinds of their own. A null text counts as a document without tokens. Other columns don't matter.
        """
        if self.committed(batch):
            return False
        return self.commit_counts(batch, with_counts(changes, ranks, text_col, source_col, lang_col, sign_col), tokenizer)

    def commit_counts(self, batch: str, counted: DataFrame, tokenizer: str) -> bool:
        """Apply a batch of signed counts (source, lang, sign, tokens, chars)."""
        if self.committed(batch):
            return False
        sums = [F.sum(F.col("sign").cast("bigint")).alias("docs"), *(F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("tokens", "chars"))]
        delta = counted.where("sign <> 0").groupBy("source", "lang").agg(*sums)
        data = f"data-{uuid.uuid4().hex}"
        delta.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), "docs", "tokens", "chars").write.parquet(f"{self.folder}/{data}")
        marker = self._path(f"{self.folder}/commit-{batch}")
        if self._fs.exists(marker) and self._fs.getFileStatus(marker).getLen() == 0:
            self._fs.delete(marker, False)
        if not self._create(f"commit-{batch}", data):
            self._fs.delete(self._path(f"{self.folder}/{data}"), True)
            return False
        if len(self._fs.globStatus(self._path(f"{self.folder}/commit-*"))) >= FOLD_EVERY:
            self.fold()
        return True

    def _open(self) -> tuple[str | None, dict[str, str]]:
        """The base's folder, and the commits that it doesn't hold."""
        markers = self._markers("commit")
        base = self._base()[1]
        if base and markers:
            held = self.spark.read.parquet(f"{self.folder}/{base}/batches").where(F.col("batch").isin(list(markers))).collect()
            for r in held:
                del markers[r.batch]
        return base, markers

    def _sum(self, base: str | None, markers: dict[str, str]) -> DataFrame:
        paths = [f"{self.folder}/{x}" for x in sorted(markers.values())] + ([f"{self.folder}/{base}/totals"] if base else [])
        if not paths:
            return self.spark.createDataFrame([], ROLLUP)
        sums = [F.sum(c).alias(c) for c in ("docs", "tokens", "chars")]
        all_ = self.spark.read.schema(ROLLUP).parquet(*paths).groupBy("source", "lang", "tokenizer").agg(*sums)
        return all_.where("docs <> 0 OR tokens <> 0 OR chars <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens, chars), kinds that came back to nothing left out."""
        return self._sum(*self._open())

    def fold(self) -> bool:
        """Make a base of the last one and all commits since; False if another writer made it first. What it
        holds is deleted only after it is there; a reader that still has the old files must read totals again."""
        number, _ = self._base()
        base, markers = self._open()
        folder = f"folded-{uuid.uuid4().hex}"
        self._sum(base, markers).write.parquet(f"{self.folder}/{folder}/totals")
        names = self.spark.createDataFrame([(x,) for x in markers], "batch string")
        if base:
            names = names.unionByName(self.spark.read.parquet(f"{self.folder}/{base}/batches"))
        names.write.parquet(f"{self.folder}/{folder}/batches")
        if not self._create(f"base-{number + 1}", folder):
            self._fs.delete(self._path(f"{self.folder}/{folder}"), True)
            return False
        for batch, data in markers.items():
            self._fs.delete(self._path(f"{self.folder}/commit-{batch}"), False)
            self._fs.delete(self._path(f"{self.folder}/{data}"), True)
        if base:
            self._fs.delete(self._path(f"{self.folder}/base-{number}"), False)
            self._fs.delete(self._path(f"{self.folder}/{base}"), True)
        return True


def tidied(text: str) -> str:
    """Runs of white space as one space, none at the ends."""
    return " ".join(text.split())


def count_tokens(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k",
    ranks: str = RANKS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """The rollup of a table that is loaded, then revised, then freed of copies, each as one batch of signed counts.

    Batch ``load`` inserts every row; it is sent twice and counts once. Batch ``tidy`` revises every text whose white space
    isn't single spaces: the old count goes and the new one comes. Batch ``copies`` deletes rows whose tidied text
    a smaller doc_id has. Returns (source, lang, tokenizer, docs, tokens, chars). Null texts count as documents without
    tokens and are no copies; null ids stay; rows that repeat a doc_id stay or go together. An empty table gives no rows;
    null sources and languages are kinds of their own; other columns don't matter.
    """
    rows = docs.select(
        F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"),
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            for at, part in A.slices(batch.column(3)):
                rest = batch.slice(at, len(part))
                texts = part.to_pylist()
                new = [tidied(t) for t in texts]
                old = [token_count(ranks, t) for t in texts]
                counts = [old, [len(t) for t in texts], [n if a == b else token_count(ranks, b) for n, a, b in zip(old, texts, new)], [len(t) for t in new]]
                key = [blake2b(t.encode(), digest_size=16).digest() if ok else None for t, ok in zip(new, rest.column(3).is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns[:3], *(pa.array(c, pa.int64()) for c in counts), pa.array(key, pa.binary())],
                    names=["source", "lang", "doc_id", "tokens", "chars", "new_tokens", "new_chars", "key"],
                )

    schema = "source string, lang string, doc_id bigint, tokens bigint, chars bigint, new_tokens bigint, new_chars bigint, key binary"
    with jobs.Scratch(docs.sparkSession) as tmp:
        rollup = TokenRollup(docs.sparkSession, f"{tmp.folder}/rollup")
        counted = tmp.save(rows.mapInArrow(run, schema))
        signed = lambda df, sign, new: df.select("source", "lang", F.lit(sign).alias("sign"), F.col(f"{new}tokens").alias("tokens"), F.col(f"{new}chars").alias("chars"))
        for _ in range(2):
            rollup.commit_counts("load", signed(counted, 1, ""), tokenizer)
        changed = counted.where("tokens <> new_tokens OR chars <> new_chars")
        rollup.commit_counts("tidy", signed(changed, -1, "").unionByName(signed(changed, 1, "new_")), tokenizer)
        keyed = counted.where("key IS NOT NULL")
        first = tmp.save(keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL"))
        copies = jobs.join_small(keyed, first.select("key", "first"), "key", "inner", 64).where("doc_id > first")
        rollup.commit_counts("copies", signed(copies, -1, "new_"), tokenizer)
        rollup.fold()
        return tmp.keep(rollup.totals())
