"""Files to page lists: listing, containers, parsers by suffix, and an error table instead of silent loss."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlake.sources import docx, pdf

Parser = Callable[[bytes], list[str]]
#: Bytes that the members of one archive may unpack to, and how deep archives may nest.
MAX_UNPACKED = 1 << 30
MAX_DEPTH = 3


def _decode(content: bytes) -> str:
    for name in ("utf-8-sig", "cp1252"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def parse_text(content: bytes, keep_paragraphs: bool = True) -> list[str]:
    """One page. Paragraph breaks stay unless ``keep_paragraphs`` is off; without them the chunker sees one section."""
    t = _decode(content).replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"\.\.\.+", "...", t)
    t = re.sub(" +", " ", t)
    t = re.sub("\n ", "\n", t)
    t = re.sub("\n\n+", "\n\n", t) if keep_paragraphs else re.sub("\n+", "\n", t)
    return [t.strip()]


PARSERS: dict[str, Parser] = {".txt": parse_text, ".md": parse_text, ".docx": docx.parse_docx, ".pdf": pdf.parse_pdf}


def suffix_of(name: str) -> str:
    return posixpath.splitext(name.lower())[1]


def safe_member(name: str) -> str | None:
    """A member's path inside its archive, None for directories and paths that lead out of it."""
    name = name.replace("\\", "/")
    if name.endswith("/") or name.startswith("/") or re.match(r"[A-Za-z]:", name):
        return None
    clean = posixpath.normpath(name)
    return None if clean.startswith("..") else clean


def members(path: str, content: bytes, depth: int = 0) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(path, content, error) of a file, or of all files in it if it is an archive, nested ones too."""
    if suffix_of(path) != ".zip":
        yield path, content, None
        return
    if depth >= MAX_DEPTH:
        yield path, None, "archives nested too deep"
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        room = MAX_UNPACKED
        for info in archive.infolist():
            name = safe_member(info.filename)
            if name is None:
                if not info.is_dir():
                    yield f"{path}!{info.filename}", None, "path leads out of the archive"
                continue
            room -= info.file_size
            if room < 0:
                yield f"{path}!{name}", None, "archive too large"
                return
            with archive.open(info) as f:
                inner = f.read(info.file_size + 1)
            if len(inner) > info.file_size:
                yield f"{path}!{name}", None, "member larger than it says"
                continue
            yield from members(f"{path}!{name}", inner, depth + 1)
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError, EOFError) as e:
        yield path, None, f"bad archive: {e}"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content) of all files below a folder but temporary ones (``~$...``).

    ``content`` is read only where it is used: a plan that drops it lists the files alone.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(~F.startswith(F.element_at(F.split("path", "/"), -1), F.lit("~$")))


PAGES = "path string, file string, pages array<string>, error string"


def parse_files(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """(path, file, pages, error) of every file and archive member; exactly one of pages and error is null.

    Unsupported types, broken files and unsafe members each give an error row.
    """
    table = parsers or PARSERS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                for name, inner, error in members(path, bytes(content) if content is not None else b""):
                    file = re.split("[/!]", name)[-1]
                    pages = None
                    if error is None and not file.startswith("~$"):
                        parser = table.get(suffix_of(name))
                        if parser is None:
                            error = f"unsupported type {suffix_of(name) or 'without suffix'}"
                        else:
                            try:
                                pages = parser(inner)
                            except Exception as e:  # a parser meets arbitrary bytes; its failure is a row
                                error = f"{type(e).__name__}: {e}"
                    if error is not None or pages is not None:
                        rows.append((name, file, pages, error))
                yield pd.DataFrame(rows, columns=["path", "file", "pages", "error"])

    return files.select("path", "content").mapInPandas(run, PAGES)


def load_documents(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages and errors of the files that a manifest (path, modificationTime) doesn't hold yet."""
    from skeinlake.sources.tables import unseen

    files = list_files(spark, folder)
    if manifest is not None:
        files = unseen(files, manifest)
    parsed = parse_files(files)
    return parsed.where("error IS NULL").drop("error"), parsed.where("error IS NOT NULL").select("path", "file", "error")
