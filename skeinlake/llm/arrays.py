"""Vectorised token hashing over Arrow string columns.

A slice of texts is one byte array with offsets. Tokens are maximal runs of bytes of a class:

* ``SPACED``: anything but ASCII white space, as it stands; used where repeats must be literal.
* ``WORDS``: letters, marks and digits of any script; used after ``normalised``, where punctuation and case must
  not matter. Han, Hiragana and Katakana, which are written without spaces, are words of one character each.

Hashes are polynomial in the bytes (or in the token hashes), taken modulo 2**64 with an odd base,
so any window's hash comes from two prefix sums, and finished with a mixer.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

U64 = np.uint64
SPACED, WORDS = "spaced", "words"
_SPACE = frozenset(b" \t\n\r\x0b\x0c")
_BYTE_CLASS = {
    SPACED: np.array([b not in _SPACE for b in range(256)], np.uint8),
    WORDS: np.array([b < 128 and chr(b).isalnum() for b in range(256)], np.uint8),
}

_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}

#: Texts are handled in slices of about so many bytes, so that working arrays stay small.
SLICE_BYTES = (1 << 19) - 64


@cache
def _code_classes() -> np.ndarray:
    """Class of each code point: 1 in a word, 2 a word by itself, 3 a mark, 0 between words."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((1, r"[\p{L}\p{N}]+"), (2, r"[[\p{L}]&&[\p{Han}\p{Hiragana}\p{Katakana}]]+"), (3, r"\p{M}+")):
        for m in regex.finditer(pattern, every, regex.V1):
            a, b = m.span()
            out[a + 0x800 * (a >= 0xD800) : b + 0x800 * (b > 0xD800)] = kind
    return out


def byte_classes(data: np.ndarray, kind: str) -> np.ndarray:
    """Class of each byte; those of one character have the same. A mark is of its letter, with 4 for one after a letter of 2."""
    out = _BYTE_CLASS[kind][data]
    lead = np.flatnonzero(data >= 0xC0) if kind == WORDS else ()
    if len(lead):
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & (0xFF >> (size + 1))
        place = np.minimum(lead[:, None] + np.arange(4), len(data) - 1)
        for k in range(1, 4):
            more = size > k
            code[more] = code[more] << 6 | data[place[more, k]] & 0x3F
        of = _code_classes()[np.minimum(code, 0x10FFFF)]
        for k in range(4):
            more = size > k
            out[place[more, k]] = of[more]
        marks = np.flatnonzero(of == 3)
        if len(marks):
            at = lead[marks]
            for first in np.split(marks, np.flatnonzero(at[1:] != at[:-1] + size[marks[:-1]]) + 1) if (of == 2).any() else ():
                alone = lead[first[0]] > 0 and out[lead[first[0]] - 1] == 2
                for k in range(4):
                    out[place[first[size[first] > k], k]] = 4 if alone else 1
            out[out == 3] = 1
    return out


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of them."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.ones(size, U64)
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * U64(pow(base, done, 2**64))
                done *= 2
            _powers[name] = out
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit values."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xC2B2AE3D27D4EB4F)
    x ^= x >> U64(32)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i``, with a leading zero."""
    up, _ = _power(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in ``[start, end)``, wherever they stand."""
    _, down = _power(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls; null texts become empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def _decomposed(column: pa.Array) -> pa.Array:
    return pc.utf8_normalize(column, form="NFKD")


def normalised(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Compatibility decomposition (NFKD), the same for all that NFKC makes equal, and lower case."""
    column = as_strings(column)
    plain = pc.string_is_ascii(column)
    if not pc.all(plain, min_count=0).as_py():
        other = pc.invert(plain)
        column = pc.replace_with_mask(column, other, _decomposed(column.filter(other)))
    return pc.utf8_lower(column)


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends, in the text as it stands, of the words of its normalised form."""
    tok = Tokens(_decomposed(pa.array([text], pa.large_string())), WORDS, hashed=False)
    parts: list[str] = []
    for c in text:
        if parts and not c.isascii() and unicodedata.combining(unicodedata.normalize("NFKD", c)[0]):
            parts[-1] += c
        else:
            parts.append(c)
    here = np.cumsum([0, *(len(x.encode()) for x in parts)])
    there = np.cumsum([0, *pc.binary_length(_decomposed(pa.array(parts, pa.large_string()))).to_pylist()])
    first = np.minimum(np.searchsorted(there, tok.start, "right") - 1, len(parts) - 1)
    last = np.minimum(np.searchsorted(there, tok.end, "left"), len(parts))
    return here[first], here[last]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a large_string array."""
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about ``size`` bytes each as string arrays, with the first row's index; a longer text is alone."""
    length = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    off = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, as_strings(column.slice(at, to - at))
        at = to


def normal_slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The same, normalised."""
    for at, part in slices(column):
        yield at, normalised(part)


class Tokens:
    """Tokens of a slice: byte ``start`` and ``end``, ``hash``, and ``first[i]``, the index of row i's first token."""

    __slots__ = ("data", "offsets", "start", "end", "first", "hash")

    def __init__(self, column: pa.Array, kind: str = SPACED, hashed: bool = True):
        self.data, self.offsets = buffers(column)
        data, off = self.data, self.offsets
        of = byte_classes(data, kind)
        inside = of > 0
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = ~(inside[1:] & inside[:-1])
        if kind == WORDS and (of == 2).any():
            alone = (of == 2) | (of == 4)
            edge[1:-1] |= (alone[1:] | alone[:-1]) & (data[1:] & 0xC0 != 0x80) & (of[1:] != 4)
        edge[off] = True
        self.start = np.flatnonzero(inside & edge[:-1])
        self.end = np.flatnonzero(inside & edge[1:]) + 1
        self.first = np.searchsorted(self.start, off)
        self.hash = span_hash(prefix(_BYTES[data]), self.start, self.end) if hashed else None

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    if len(x) < width:
        return x[:0]
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices ``start[i] .. start[i] + count[i] - 1``, one after another."""
    count = np.asarray(count, np.int64)
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(np.asarray(start, np.int64) - (ends - count), count)


def runs_of(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal values."""
    n = len(sorted_values)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return at, np.diff(np.append(at, n))


def merge_spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans by row, sorted; touching spans become one."""
    if len(row) == 0:
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    new_row = np.concatenate([[True], row[1:] != row[:-1]])
    base = np.cumsum(new_row).astype(np.int64) * (int(end.max()) + 2)  # rows far apart on one axis
    reach = np.maximum.accumulate(base + end)
    new = new_row.copy()
    new[1:] |= (base + start)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1
    return row[at], start[at], (reach - base)[last]
