"""PDF files to Markdown pages, with the standard library alone.

Objects are found by cross-reference tables and streams, or by scanning where those are damaged. A page's content
stream is interpreted for text and ruled lines; glyphs become words, lines, paragraphs and, inside grids of ruled
lines, tables. Font sizes become heading levels. Flate is the only filter (with PNG predictors); encrypted files raise.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from typing import Any

from skeinlake.operators.chunking import heading_levels
from skeinlake.sources.docx import tidy


class PdfError(ValueError):
    """The file can't be read."""


class Name(str):
    __slots__ = ()


class Op(str):
    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    head: dict
    raw: bytes


_WHITE = b" \t\r\n\f\0"
_DELIMITERS = b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^ \t\r\n\f\0()<>\[\]{}/%]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_END = object()


class Lexer:
    """Values and operators from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _skip(self) -> None:
        data = self.data
        while self.at < len(data):
            c = data[self.at]
            if c in _WHITE:
                self.at += 1
            elif c == 0x25:
                ends = [e for e in (data.find(b"\n", self.at), data.find(b"\r", self.at)) if e >= 0]
                self.at = min(ends) if ends else len(data)
            else:
                return

    def value(self) -> Any:
        """The next value; ``_END`` at the end. References need ``with_refs``."""
        self._skip()
        data = self.data
        if self.at >= len(data):
            return _END
        c = data[self.at : self.at + 1]
        if c == b"/":
            m = _REGULAR.match(data, self.at + 1)
            self.at = m.end() if m else self.at + 1
            raw = m.group() if m else b""
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x.group(1), 16)]), raw).decode("latin-1"))
        if c == b"(":
            return self._literal()
        if data[self.at : self.at + 2] == b"<<":
            self.at += 2
            return self._dict()
        if c == b"<":
            end = data.find(b">", self.at)
            end = len(data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            return self._until(Op("]"))
        if data[self.at : self.at + 2] == b">>":
            self.at += 2
            return Op(">>")
        if c in (b"]", b"}", b"{", b")", b">"):
            self.at += 1
            return Op(c.decode())
        m = _REGULAR.match(data, self.at)
        self.at = m.end()
        word = m.group()
        try:
            return int(word)
        except ValueError:
            pass
        if re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", word):
            return float(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, Op(word.decode("latin-1")))

    def _until(self, end: Op) -> list:
        out: list[Any] = []
        while True:
            v = self.value()
            if v is _END or (isinstance(v, Op) and v == end):
                return out
            if isinstance(v, Op) and v == "R" and len(out) >= 2 and isinstance(out[-2], int):
                out[-2:] = [Ref(out[-2])]
            else:
                out.append(v)

    def _dict(self) -> dict:
        flat = self._until(Op(">>"))
        return {flat[i]: flat[i + 1] for i in range(0, len(flat) - 1, 2) if isinstance(flat[i], Name)}

    def _literal(self) -> bytes:
        out, depth, data = bytearray(), 1, self.data
        self.at += 1
        while self.at < len(data):
            c = data[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                m = re.compile(rb"[0-7]{1,3}").match(data, self.at)
                if m:
                    out.append(int(m.group(), 8) & 255)
                    self.at = m.end()
                    continue
                e = data[self.at : self.at + 1]
                self.at += 2 if data[self.at : self.at + 2] == b"\r\n" else 1
                if e not in (b"\r", b"\n"):
                    out += _ESCAPES.get(e, e)
                continue
            if c == b"(":
                depth += 1
            elif c == b")":
                depth -= 1
                if not depth:
                    break
            out += c
        return bytes(out)


def _unpredict(data: bytes, parms: dict) -> bytes:
    kind = parms.get("Predictor", 1)
    if kind < 2:
        return data
    colors, bits, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    width, step = (colors * bits * columns + 7) // 8, max(1, colors * bits // 8)
    if kind == 2:
        raise PdfError("TIFF predictor")
    out, before = bytearray(), bytes(width)
    for at in range(0, len(data) - width, width + 1):
        how, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(width):
            a = row[i - step] if i >= step else 0
            b = before[i]
            c = before[i - step] if i >= step else 0
            if how == 1:
                add = a
            elif how == 2:
                add = b
            elif how == 3:
                add = (a + b) // 2
            elif how == 4:
                p = a + b - c
                add = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                add = 0
            row[i] = (row[i] + add) & 255
        out += row
        before = bytes(row)
    return bytes(out)


class Document:
    """Objects of a file, loaded on demand."""

    def __init__(self, data: bytes):
        start = data.find(b"%PDF-")
        if start < 0:
            raise PdfError("not a PDF file")
        self.data = data[start:]
        self.places: dict[int, tuple[int, int]] = {}  # (offset, -1) or (stream number, index)
        self.trailer: dict = {}
        self.cache: dict[int, Any] = {}
        try:
            self._cross_references()
        except (PdfError, IndexError, TypeError, KeyError, ValueError, zlib.error):
            self.places, self.trailer = {}, {}
        if "Root" not in self.trailer or not isinstance(self.get(self.trailer["Root"]), dict):
            self._scan()
        if "Encrypt" in self.trailer:
            raise PdfError("encrypted")

    def _cross_references(self) -> None:
        found = re.findall(rb"startxref\s+(\d+)", self.data)
        todo, seen = [int(found[-1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen or at >= len(self.data):
                continue
            seen.add(at)
            lex = Lexer(self.data, at)
            first = lex.value()
            if first == "xref":
                head = self._table(lex)
            else:
                head = self._stream_table(at)
            self.trailer = {**head, **self.trailer}
            todo += [int(head[k]) for k in ("XRefStm", "Prev") if k in head]

    def _table(self, lex: Lexer) -> dict:
        while True:
            first = lex.value()
            if not isinstance(first, int):
                break
            for number in range(first, first + lex.value()):
                offset, _, kind = lex.value(), lex.value(), lex.value()
                if kind == "n":
                    self.places.setdefault(number, (offset, -1))
        head = lex.value()
        return head if isinstance(head, dict) else {}

    def _stream_table(self, at: int) -> dict:
        s = self._object_at(at, None)
        if not isinstance(s, Stream):
            raise PdfError("no cross-reference stream")
        rows, widths = self.decoded(s), s.head["W"]
        index = s.head.get("Index") or [0, s.head["Size"]]
        size, k = sum(widths), 0
        for first, count in zip(index[::2], index[1::2]):
            for number in range(first, first + count):
                row, fields = rows[k * size : (k + 1) * size], []
                k += 1
                for w in widths:
                    fields.append(int.from_bytes(row[:w], "big") if w else None)
                    row = row[w:]
                kind = 1 if fields[0] is None else fields[0]
                if kind == 1:
                    self.places.setdefault(number, (fields[1], -1))
                elif kind == 2:
                    self.places.setdefault(number, (fields[1], fields[2] or 0))
        return s.head

    def _scan(self) -> None:
        """All objects by their headings, for files whose tables are damaged."""
        self.cache = {}
        self.places = {int(m.group(1)): (m.start(1), -1) for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b", self.data)}
        for number in list(self.places):
            try:
                obj = self.get(Ref(number))
                if isinstance(obj, Stream) and obj.head.get("Type") == "ObjStm":
                    lex = Lexer(self.decoded(obj))
                    for i in range(self.get(obj.head["N"])):
                        inner, _ = lex.value(), lex.value()
                        self.places.setdefault(inner, (number, i))
            except (PdfError, TypeError, KeyError, ValueError, zlib.error):
                continue
        for m in re.finditer(rb"trailer", self.data):
            head = Lexer(self.data, m.end()).value()
            self.trailer.update(head if isinstance(head, dict) else {})
        if "Root" not in self.trailer:
            for number in self.places:
                obj = self.get(Ref(number))
                head = obj.head if isinstance(obj, Stream) else obj
                if isinstance(head, dict) and head.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(number)
                if isinstance(head, dict) and head.get("Type") == "XRef" and "Encrypt" in head:
                    self.trailer["Encrypt"] = head["Encrypt"]
        if "Root" not in self.trailer:
            raise PdfError("no catalogue")

    def _object_at(self, at: int, number: int | None) -> Any:
        m = re.compile(rb"\s*(\d+)\s+\d+\s+obj\b").match(self.data, at)
        if m is None or (number is not None and int(m.group(1)) != number):
            near = re.compile(rb"(?<![0-9])%d\s+\d+\s+obj\b" % (number or 0)).search(self.data, max(0, at - 511), at + 511)
            if near is None or number is None:
                raise PdfError(f"object {number} isn't where it should be")
            m = near
        lex = Lexer(self.data, m.end())
        v = lex.value()
        if isinstance(v, int):  # an object may be a reference
            save = lex.at
            if isinstance(lex.value(), int) and lex.value() == "R":
                return Ref(v)
            lex.at = save
        if isinstance(v, dict):
            m = re.compile(rb"\s*stream(\r\n|\n|\r)?").match(self.data, lex.at)
            if m:
                size = v.get("Length")
                size = self.get(size) if isinstance(size, Ref) else size
                end = m.end() + size if isinstance(size, int) else -1
                if end < 0 or not re.compile(rb"\s*endstream").match(self.data, end):
                    end = self.data.find(b"endstream", m.end())
                return Stream(v, self.data[m.end() : end if end >= 0 else len(self.data)])
        return v

    def get(self, v: Any, depth: int = 0) -> Any:
        """A value with references followed; a missing object is null."""
        if not isinstance(v, Ref):
            return v
        if depth > 30:
            raise PdfError("circular reference")
        if v.number not in self.cache:
            place = self.places.get(v.number)
            obj = None
            if place is not None and place[1] < 0:
                obj = self._object_at(place[0], v.number)
            elif place is not None:
                holder = self.get(Ref(place[0]), depth + 1)
                data = self.decoded(holder)
                lex = Lexer(data)
                heads = [(lex.value(), lex.value()) for _ in range(self.get(holder.head["N"]))]
                first = self.get(holder.head["First"])
                for number, offset in heads:
                    if number == v.number:
                        obj = Lexer(data, first + offset).value()
            self.cache[v.number] = obj
        return self.get(self.cache[v.number], depth + 1)

    def decoded(self, s: Stream) -> bytes:
        filters = self.get(s.head.get("Filter")) or []
        parms = self.get(s.head.get("DecodeParms")) or []
        filters = filters if isinstance(filters, list) else [filters]
        parms = parms if isinstance(parms, list) else [parms]
        data = s.raw
        for i, f in enumerate(filters):
            if f not in ("FlateDecode", "Fl"):
                raise PdfError(f"filter {f}")
            try:
                data = zlib.decompress(data)
            except zlib.error:
                data = zlib.decompressobj().decompress(data)  # as far as a damaged stream goes
            p = self.get(parms[i]) if i < len(parms) else None
            data = _unpredict(data, {k: self.get(x) for k, x in p.items()}) if isinstance(p, dict) else data
        return data

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with what they inherit."""
        out: list[dict] = []
        seen: set[int] = set()

        def walk(ref: Any, inherited: dict) -> None:
            if isinstance(ref, Ref):
                if ref.number in seen:
                    return
                seen.add(ref.number)
            node = self.get(ref)
            if not isinstance(node, dict):
                return
            own = {**inherited, **{k: node[k] for k in ("Resources", "Rotate", "MediaBox") if k in node}}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, own)
            else:
                out.append({**own, **node})

        walk(self.get(self.trailer["Root"]).get("Pages"), {})
        return out


_GLYPHS = {
    "space": " ", "hyphen": "-", "period": ".", "comma": ",", "colon": ":", "semicolon": ";", "quoteright": "’", "quoteleft": "‘",
    "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi",
    "adieresis": "ä", "odieresis": "ö", "udieresis": "ü", "Adieresis": "Ä", "Odieresis": "Ö", "Udieresis": "Ü", "germandbls": "ß",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "parenleft": "(", "parenright": ")", "slash": "/", "ampersand": "&", "percent": "%", "plus": "+", "equal": "=", "underscore": "_",
    "question": "?", "exclam": "!", "eacute": "é", "egrave": "è", "agrave": "à", "ccedilla": "ç", "at": "@", "numbersign": "#",
}


class Font:
    """How codes become text and how wide they are."""

    def __init__(self, doc: Document, head: dict):
        self.wide = head.get("Subtype") == "Type0"
        self.map: dict[int, str] = {}
        self.widths: dict[int, float] = {}
        self.default = 1000.0 if self.wide else 500.0
        name = str(doc.get(head.get("BaseFont")) or "")
        self.bold = "bold" in name.lower() or "black" in name.lower()
        to_unicode = doc.get(head.get("ToUnicode"))
        if self.wide:
            inner = doc.get((doc.get(head.get("DescendantFonts")) or [{}])[0]) or {}
            self.default = float(doc.get(inner.get("DW")) or 1000)
            self._cid_widths(doc, doc.get(inner.get("W")) or [])
        else:
            first = doc.get(head.get("FirstChar")) or 0
            for i, w in enumerate(doc.get(head.get("Widths")) or []):
                self.widths[first + i] = float(doc.get(w) or 0)
            self._differences(doc, doc.get(head.get("Encoding")))
        if isinstance(to_unicode, Stream):
            self._cmap(doc.decoded(to_unicode))

    def _differences(self, doc: Document, encoding: Any) -> None:
        codec = "mac-roman" if encoding == "MacRomanEncoding" or isinstance(encoding, dict) and encoding.get("BaseEncoding") == "MacRomanEncoding" else "cp1252"
        for code in range(256):
            self.map[code] = bytes([code]).decode(codec, "ignore")
        code = 0
        for x in (doc.get(encoding.get("Differences")) or []) if isinstance(encoding, dict) else []:
            if isinstance(x, int):
                code = x
                continue
            if x in _GLYPHS or len(x) == 1:
                self.map[code] = _GLYPHS.get(x, str(x))
            elif re.fullmatch(r"uni[0-9A-Fa-f]{4}", x):
                self.map[code] = chr(int(x[3:], 16))
            code += 1

    def _cid_widths(self, doc: Document, w: list) -> None:
        i = 0
        while i < len(w) - 1:
            nxt = doc.get(w[i + 1])
            if isinstance(nxt, list):
                for k, x in enumerate(nxt):
                    self.widths[w[i] + k] = float(doc.get(x))
                i += 2
            else:
                for code in range(w[i], min(nxt, w[i] + 65535) + 1):
                    self.widths[code] = float(doc.get(w[i + 2]))
                i += 3

    def _cmap(self, data: bytes) -> None:
        lex, stack = Lexer(data), []
        text = lambda b: b.decode("utf-16-be", "ignore")
        while (v := lex.value()) is not _END:
            if not isinstance(v, Op):
                stack.append(v)
                continue
            if v == "endbfchar":
                for code, to in zip(stack[::2], stack[1::2]):
                    if isinstance(code, bytes) and isinstance(to, bytes):
                        self.map[int.from_bytes(code, "big")] = text(to)
            elif v == "endbfrange":
                for low, high, to in zip(stack[::3], stack[1::3], stack[2::3]):
                    a, b = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                    for k in range(min(b - a, 65535) + 1):
                        if isinstance(to, list):
                            self.map[a + k] = text(to[k]) if k < len(to) else ""
                        else:
                            self.map[a + k] = text(to[:-2] + (int.from_bytes(to[-2:], "big") + k & 0xFFFF).to_bytes(2, "big"))
            stack = []

    def decode(self, raw: bytes) -> list[tuple[str, float, bool]]:
        """(text, width in thousandths, is a one-byte space) of each code."""
        step = 2 if self.wide else 1
        codes = [int.from_bytes(raw[i : i + step], "big") for i in range(0, len(raw) - step + 1, step)]
        return [(self.map.get(c, ""), self.widths.get(c, self.default), step == 1 and c == 32) for c in codes]


Matrix = tuple[float, float, float, float, float, float]
_UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _times(m: Matrix, n: Matrix) -> Matrix:
    a, b, c, d, e, f = m
    g, h, i, j, k, o = n
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o)


@dataclass
class Glyphs:
    """A piece of text at a place, in page coordinates turned upright."""

    x: float
    y: float
    end: float
    size: float
    text: str
    bold: bool = False
    turn: int = 0


class _Page:
    """Interpreter of content streams."""

    def __init__(self, doc: Document):
        self.doc = doc
        self.glyphs: list[Glyphs] = []
        self.rules: list[tuple[float, float, float, float]] = []
        self.fonts: dict[int, Font] = {}

    def font(self, resources: dict, name: str) -> Font:
        head = self.doc.get((self.doc.get(resources.get("Font")) or {}).get(name)) or {}
        if id(head) not in self.fonts:
            self.fonts[id(head)] = Font(self.doc, head)
        return self.fonts[id(head)]

    def run(self, data: bytes, resources: dict, ctm: Matrix = _UNIT, depth: int = 0) -> None:
        lex, args, saved = Lexer(data), [], []
        tm = line = _UNIT
        state: dict[str, Any] = {"ctm": ctm, "font": None, "size": 1.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0}
        path: list[tuple[float, float, float, float]] = []
        here = (0.0, 0.0)

        def place(x: float, y: float) -> tuple[float, float]:
            a, b, c, d, e, f = state["ctm"]
            return a * x + c * y + e, b * x + d * y + f

        def segment(x0: float, y0: float, x1: float, y1: float) -> None:
            path.append((*place(x0, y0), *place(x1, y1)))

        def show(raw: bytes) -> None:
            nonlocal tm
            font: Font | None = state["font"]
            if font is None:
                return
            for text, width, space in font.decode(raw):
                move = (width / 1000 * state["size"] + state["char"] + (state["word"] if space else 0.0)) * state["scale"]
                full = _times((state["size"] * state["scale"], 0.0, 0.0, state["size"], 0.0, state["rise"]), _times(tm, state["ctm"]))
                size = (full[2] ** 2 + full[3] ** 2) ** 0.5
                after = _times((1.0, 0.0, 0.0, 1.0, move, 0.0), tm)
                if text:
                    end = _times(after, state["ctm"])
                    turn = 0 if abs(full[0]) >= abs(full[1]) and full[0] >= 0 else 2 if abs(full[0]) >= abs(full[1]) else 1 if full[1] > 0 else 3
                    (x, y), (x1, y1) = (_upright(full[4], full[5], turn), _upright(end[4], end[5], turn))
                    self.glyphs.append(Glyphs(x, y, x1, round(size, 1), text, font.bold, turn))
                tm = after

        while (v := lex.value()) is not _END:
            if not isinstance(v, Op):
                args.append(v)
                continue
            try:
                match v:
                    case "q":
                        saved.append(dict(state))
                    case "Q":
                        state = saved.pop() if saved else state
                    case "cm":
                        state["ctm"] = _times(tuple(map(float, args[-6:])), state["ctm"])
                    case "BT":
                        tm = line = _UNIT
                    case "Tf":
                        state["font"], state["size"] = self.font(resources, args[-2]), float(args[-1])
                    case "Tc" | "Tw" | "TL" | "Ts":
                        state[{"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise"}[v]] = float(args[-1])
                    case "Tz":
                        state["scale"] = float(args[-1]) / 100
                    case "Td" | "TD":
                        if v == "TD":
                            state["lead"] = -float(args[-1])
                        tm = line = _times((1.0, 0.0, 0.0, 1.0, float(args[-2]), float(args[-1])), line)
                    case "Tm":
                        tm = line = tuple(map(float, args[-6:]))
                    case "T*":
                        tm = line = _times((1.0, 0.0, 0.0, 1.0, 0.0, -state["lead"]), line)
                    case "Tj":
                        show(args[-1])
                    case "'" | '"':
                        if v == '"':
                            state["word"], state["char"] = float(args[-3]), float(args[-2])
                        tm = line = _times((1.0, 0.0, 0.0, 1.0, 0.0, -state["lead"]), line)
                        show(args[-1])
                    case "TJ":
                        for x in args[-1]:
                            if isinstance(x, bytes):
                                show(x)
                            else:
                                tm = _times((1.0, 0.0, 0.0, 1.0, -float(x) / 1000 * state["size"] * state["scale"], 0.0), tm)
                    case "m":
                        here = (float(args[-2]), float(args[-1]))
                    case "l":
                        segment(*here, float(args[-2]), float(args[-1]))
                        here = (float(args[-2]), float(args[-1]))
                    case "re":
                        x, y, w, h = map(float, args[-4:])
                        for s in ((x, y, x + w, y), (x, y + h, x + w, y + h), (x, y, x, y + h), (x + w, y, x + w, y + h)):
                            segment(*s)
                    case "S" | "s" | "f" | "F" | "f*" | "B" | "B*" | "b" | "b*":
                        self.rules += path
                        path = []
                    case "n":
                        path = []
                    case "Do":
                        form = self.doc.get((self.doc.get(resources.get("XObject")) or {}).get(args[-1]))
                        if isinstance(form, Stream) and form.head.get("Subtype") == "Form" and depth < 8:
                            own = self.doc.get(form.head.get("Resources")) or resources
                            matrix = tuple(map(float, self.doc.get(form.head.get("Matrix")) or _UNIT))
                            self.run(self.doc.decoded(form), own, _times(matrix, state["ctm"]), depth + 1)
                    case "BI":
                        end = re.compile(rb"[\s]EI(?=[\s])").search(data, lex.at)
                        lex.at = end.end() if end else len(data)
            except (IndexError, ValueError, TypeError, KeyError):
                pass  # an operator with wrong operands does nothing
            args = []


def _upright(x: float, y: float, turn: int) -> tuple[float, float]:
    return ((x, y), (y, -x), (-x, -y), (-y, x))[turn]


@dataclass
class Line:
    x: float
    y: float
    end: float
    size: float
    text: str
    bold: bool


def lines_of(glyphs: list[Glyphs]) -> list[Line]:
    """Glyphs on one height become a line; gaps become spaces, wide ones tabs."""
    rows: list[list[Glyphs]] = []
    for g in sorted(glyphs, key=lambda g: (-g.y, g.x)):
        if rows and abs(rows[-1][0].y - g.y) < 0.4 * max(g.size, rows[-1][0].size):
            rows[-1].append(g)
        else:
            rows.append([g])
    out = []
    for row in rows:
        row.sort(key=lambda g: g.x)
        text, end = "", None
        for g in row:
            if end is not None and not text.endswith((" ", "\t")):
                gap = g.x - end
                if gap > 3 * g.size:
                    text += "\t"
                elif gap > 0.18 * g.size and g.text != " ":
                    text += " "
            text += g.text
            end = g.end
        size = Counter()
        for g in row:
            size[g.size] += len(g.text)
        heavy = sum(len(g.text) for g in row if g.bold) * 2 > sum(len(g.text) for g in row)
        if text.strip():
            out.append(Line(row[0].x, row[0].y, end, size.most_common(1)[0][0], text.strip(), heavy))
    return out


def tables_of(rules: list[tuple[float, float, float, float]], glyphs: list[Glyphs]) -> tuple[list[tuple[float, list[list[str]]]], list[Glyphs]]:
    """Grids of at least two by two cells, as (top, rows of texts), and the glyphs outside of them."""
    flat = [(min(a, c), max(a, c), b) for a, b, c, d in rules if abs(b - d) < 1 and abs(a - c) > 5]
    tall = [(min(b, d), max(b, d), a) for a, b, c, d in rules if abs(a - c) < 1 and abs(b - d) > 5]
    group: list[tuple[set[int], set[int]]] = []
    for i, (x0, x1, y) in enumerate(flat):
        touching = {j for j, (y0, y1, x) in enumerate(tall) if x0 - 2 <= x <= x1 + 2 and y0 - 2 <= y <= y1 + 2}
        if touching:
            joined = [g for g in group if g[1] & touching]
            group = [g for g in group if not g[1] & touching]
            group.append(({i}.union(*(g[0] for g in joined)), touching.union(*(g[1] for g in joined))))

    def distinct(values: list[float]) -> list[float]:
        out: list[float] = []
        for v in sorted(values):
            if not out or v - out[-1] > 2:
                out.append(v)
        return out

    tables, rest = [], list(glyphs)
    for hs, vs in group:
        xs, ys = distinct([tall[j][2] for j in vs]), distinct([flat[i][2] for i in hs])[::-1]
        if len(xs) < 3 or len(ys) < 3:
            continue
        inside = [g for g in rest if xs[0] - 1 <= g.x <= xs[-1] and ys[-1] - 1 <= g.y <= ys[0] + 1]
        cells: dict[tuple[int, int], list[Glyphs]] = {}
        for g in inside:
            r = sum(1 for y in ys[1:-1] if g.y < y)
            c = sum(1 for x in xs[1:-1] if g.x + 0.01 >= x)
            cells.setdefault((r, c), []).append(g)
        text = [[" ".join(x.text for x in lines_of(cells.get((r, c), []))) for c in range(len(xs) - 1)] for r in range(len(ys) - 1)]
        tables.append((ys[0], text))
        drop = {id(g) for g in inside}
        rest = [g for g in rest if id(g) not in drop]
    return tables, rest


def paragraphs(lines: list[Line]) -> list[Line]:
    """Lines of one size that follow closely become a paragraph; a hyphen at a line's end goes."""
    out: list[Line] = []
    last_y = 0.0
    for line in lines:
        before = out[-1] if out else None
        close = before is not None and 0 < last_y - line.y <= 1.6 * line.size and before.size == line.size and before.bold == line.bold
        if close and not re.match(r"[•\-–*]\s|\d+[.)]\s", line.text):
            if re.search(r"[a-zà-ÿ]-$", before.text) and re.match(r"[a-zà-ÿ]", line.text):
                before.text = before.text[:-1] + line.text
            else:
                before.text += " " + line.text
        else:
            out.append(Line(**vars(line)))
        last_y = line.y
    return out


def parse_pdf(content: bytes) -> list[str]:
    """Markdown pages of a PDF file."""
    doc = Document(content)
    laid = []
    for head in doc.pages():
        page = _Page(doc)
        streams = doc.get(head.get("Contents"))
        streams = streams if isinstance(streams, list) else [streams]
        data = b"\n".join(doc.decoded(s) for s in map(doc.get, streams) if isinstance(s, Stream))
        page.run(data, doc.get(head.get("Resources")) or {})
        votes = Counter()
        for g in page.glyphs:
            votes[g.turn] += len(g.text)
        turn = votes.most_common(1)[0][0] if votes else 0
        glyphs = [g for g in page.glyphs if g.turn == turn]
        rules = [(*_upright(a, b, turn), *_upright(c, d, turn)) for a, b, c, d in page.rules]
        tables, rest = tables_of(rules, glyphs)
        laid.append((tables, lines_of(rest)))
    chars: dict[float, int] = {}
    for _, lines in laid:
        for line in lines:
            chars[line.size] = chars.get(line.size, 0) + len(line.text)
    levels = heading_levels(chars)
    escape = lambda t: t.replace("*", r"\*").replace("|", r"\|")
    out = []
    for tables, lines in laid:
        blocks = []
        tops = sorted((top for top, _ in tables), reverse=True)
        stretch: dict[int, list[Line]] = {}
        for line in lines:
            stretch.setdefault(sum(1 for t in tops if line.y < t), []).append(line)
        for k, part in stretch.items():
            for p in paragraphs(part):
                level = levels[p.size]
                mark = "#" * level + " " if level < 4 else ""
                blocks.append((-k * 2, f"{mark}**{escape(p.text)}**" if p.bold else mark + escape(p.text)))
        for top, rows in tables:
            lines_ = ["|" + "|".join(escape(c) for c in row) + "|" for row in rows]
            lines_.insert(1, "|" + "-------|" * len(rows[0]))
            blocks.append((-(sum(1 for t in tops if top < t) * 2 + 1), "\n".join(lines_)))
        blocks.sort(key=lambda b: -b[0])
        out.append(tidy("\n\n".join(b for _, b in blocks)))
    return out
