"""Operator 2: chat formatting with offset-aligned masks.

A conversation is rendered as one text, ``<|role|>`` newline, content, ``<|end|>`` newline a turn, and
encoded once with offsets. The spans of trained turns (content and end mark) are sorted by nature; each
token finds its span by binary search, and is trained on if it lies inside. A token that
straddles a border is not.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_BATCH_CHARS = 1 << 19
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once a worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def render(turns: list[dict], trained: frozenset[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """Text, and starts and ends of the trained spans."""
    out, at, start, end = [], 0, [], []
    for t in turns:
        role, text = t["role"] or "user", t["text"] or ""
        head, body = f"<|{role}|>\n", f"{text}<|end|>\n"
        if role in trained:
            start.append(at + len(head))
            end.append(at + len(head) + len(body))
        out += [head, body]
        at += len(head) + len(body)
    return "".join(out), np.array(start, np.int64), np.array(end, np.int64)


def mask_of(offsets: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """1 for each token (begin, finish) that lies inside a span."""
    if not len(start) or not len(offsets):
        return np.zeros(len(offsets), np.int8)
    i = np.searchsorted(start, offsets[:, 0], "right") - 1
    return ((i >= 0) & (offsets[:, 1] <= end[np.maximum(i, 0)])).astype(np.int8)


def format_conversations(
    turns: DataFrame,
    vocabulary: str = VOCABULARY,
    trained_roles: tuple[str, ...] = ("assistant",),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, turns, tokens, trained_tokens, input_ids, loss_mask) of each conversation.

    Turns go by number, nulls last, ties by role and text; a repeated row is a repeated turn. A null role counts as
    user, a null text as empty. Rows without conv_id belong to no conversation and are left out. An empty
    table gives no rows; extra columns don't matter.
    """
    turn = F.struct(
        F.col(turn_col).isNull().alias("late"), F.col(turn_col).cast("bigint").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    )
    grouped = (
        turns.where(F.col(conv_col).isNotNull())
        .groupBy(F.col(conv_col).cast("bigint").alias("conv_id"))
        .agg(F.array_sort(F.collect_list(turn)).alias("all"))
    )
    trained = frozenset(trained_roles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)

        def encoded(ids: list, many: list[list[dict]]) -> pa.RecordBatch:
            rendered = [render(x, trained) for x in many]
            codes = tok.encode_batch([r[0] for r in rendered], add_special_tokens=False)
            masks = [mask_of(np.array(e.offsets, np.int64).reshape(-1, 2), s, t) for e, (_, s, t) in zip(codes, rendered)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([len(x) for x in many], pa.int32()), pa.array([len(m) for m in masks], pa.int32()),
                    pa.array([int(m.sum()) for m in masks], pa.int32()), pa.array([e.ids for e in codes], pa.list_(pa.int32())),
                    pa.array([m.tolist() for m in masks], pa.list_(pa.int8())),
                ],
                names=["conv_id", "turns", "tokens", "trained_tokens", "input_ids", "loss_mask"],
            )

        for batch in batches:
            ids: list = []
            many: list[list[dict]] = []
            held = 0
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(c)
                many.append(x.as_py())
                held += sum(len(t["text"] or "") for t in many[-1])
                if held > _BATCH_CHARS:
                    yield encoded(ids, many)
                    ids, many, held = [], [], 0
            if ids:
                yield encoded(ids, many)

    schema = "conv_id bigint, turns int, tokens int, trained_tokens int, input_ids array<int>, loss_mask array<tinyint>"
    return grouped.mapInArrow(run, schema)
