"""Header-aware chunking of page lists."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skeinlake.functions import text as T

CHUNK = "chunk_no int, h1 string, h2 string, h3 string, body string, ref array<int>"
_MARKS = (("# ", 0), ("## ", 1), ("### ", 2))


def split_pages(pages: list[str | None], max_chunk_size: int = 4096) -> list[dict]:
    """Chunks of a document's pages.

    Sections are divided by empty lines. A section that begins with one to three hashes and a space is a
    heading; adjacent headings of a level are joined, and a heading ends the chunk before it if that has a body. A body grows by
    sections while their lengths, separators not counted, stay within the size; a section is never
    divided. Headings without a body give no chunk. Bodies go on across pages; ``ref`` has their page indexes.
    """
    chunks: list[dict] = []
    heads = ["", "", ""]
    body: list[str] | None = None
    length = 0
    ref: list[int] = []
    last = -1

    def flush() -> None:
        nonlocal body, length, ref
        if body is not None:
            chunks.append({"h1": heads[0], "h2": heads[1], "h3": heads[2], "body": "\n\n".join(body), "ref": ref})
        body, length, ref = None, 0, []

    for page, content in enumerate(pages):
        for section in (content or "").split("\n\n"):
            level = next((k for mark, k in _MARKS if section.startswith(mark)), None)
            if level is not None:
                flush()
                title = section[level + 2 :]
                heads[level] = f"{heads[level]} {title}" if last == level else title
                for below in range(level + 1, 3):
                    heads[below] = ""
                last = level
                continue
            last = -1
            if body is not None and length + len(section) > max_chunk_size:
                flush()
            if body is None:
                body = []
            body.append(section)
            length += len(section) if len(body) == 1 else len(section) + 2
            if not ref or ref[-1] != page:
                ref.append(page)
    flush()
    return chunks


def chunk_documents(docs: DataFrame, max_chunk_size: int = 4096, id_col: str = "doc_id", pages_col: str = "pages") -> DataFrame:
    """Rows of (id, pages) to chunks with rendered content and page hint. The fold is within a row, so nothing is shuffled.

    A document without pages (null or empty list) has no chunk; a null page is an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"id": i, "chunk_no": n, **c}
                for i, pages in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for n, c in enumerate(split_pages(pages or [], max_chunk_size))
            ]
            if rows:
                names = ["id", "chunk_no", "h1", "h2", "h3", "body"]
                kinds = [batch.schema.field(0).type, pa.int32(), *[pa.string()] * 4]
                columns = [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)]
                columns.append(pa.array([r["ref"] for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "ref"])

    chunks = docs.select(F.col(id_col).alias("id"), F.col(pages_col).alias("pages")).mapInArrow(run, f"id {kind}, {CHUNK}")
    return chunks.select(
        F.col("id").alias(id_col), "chunk_no", "h1", "h2", "h3", "body", "ref",
        T.render_chunk(F.col("h1"), F.col("h2"), F.col("h3"), F.col("body")).alias("content"),
        T.page_hint(F.col("ref")).alias("page_hint"),
    )


def heading_levels(chars_by_size: dict[float, int]) -> dict[float, int]:
    """Heading level (4 is body text) of each font size, from how many characters have it.

    Sizes go up. Where a size is used by more than a thousandth of all characters and the smaller ones since the last
    step make up over half of what was left, the level rises by one, to 1 at most.
    """
    total = left = sum(chars_by_size.values())
    level, seen, out = 4, 0, {}
    for size in sorted(chars_by_size):
        count = chars_by_size[size]
        if count > int(total * 0.001) and seen > 0.5 * left:
            level = max(level - 1, 1)
            left -= seen
            seen = 0
        seen += count
        out[size] = level
    return out
