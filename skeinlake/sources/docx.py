"""Word documents to Markdown pages, with the standard library alone.

A walk over the body yields runs of (text, size, bold) and tables, page by page; fonts come from run, paragraph
style, its ancestors and the document's defaults, nearest first. Font sizes then become heading levels.
"""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree

from skeinlake.operators.chunking import heading_levels

_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"


@dataclass
class Run:
    text: str
    size: int = -1
    bold: bool = False


@dataclass
class Table:
    rows: list[list[list[Run]]] = field(default_factory=list)


@dataclass(frozen=True)
class Look:
    size: int | None = None
    bold: bool | None = None

    def over(self, base: Look) -> Look:
        return Look(base.size if self.size is None else self.size, base.bold if self.bold is None else self.bold)


def _value(node: ElementTree.Element | None, default: str = "") -> str:
    return default if node is None else node.attrib.get(f"{_NS}val", default)


def _number(text: str, default: int) -> int:
    try:
        return int(float(text.strip()))
    except ValueError:
        return default


def _look(properties: ElementTree.Element | None) -> Look:
    if properties is None:
        return Look()
    size, bold = properties.find(f"{_NS}sz"), properties.find(f"{_NS}b")
    return Look(
        None if size is None else _number(_value(size), -1),
        None if bold is None else _value(bold, "1").lower() not in ("0", "false", "off", "none"),
    )


class Styles:
    """Looks, numbering and following style by style id."""

    def __init__(self, root: ElementTree.Element | None):
        self.nodes = {} if root is None else {s.attrib.get(f"{_NS}styleId", ""): s for s in root.iter(f"{_NS}style")}
        path = f"{_NS}docDefaults/{_NS}rPrDefault/{_NS}rPr"
        self.base = _look(None if root is None else root.find(path))
        self.default = next((i for i, s in self.nodes.items() if s.attrib.get(f"{_NS}type") == "paragraph" and s.attrib.get(f"{_NS}default") == "1"), "")

    def look(self, style: str, seen: frozenset[str] = frozenset()) -> Look:
        node = self.nodes.get(style)
        if node is None or style in seen:
            return self.base
        parent = _value(node.find(f"{_NS}basedOn"))
        return _look(node.find(f"{_NS}rPr")).over(self.look(parent, seen | {style}))

    def numbering(self, style: str) -> ElementTree.Element | None:
        node = self.nodes.get(style)
        return None if node is None else node.find(f"{_NS}pPr/{_NS}numPr")

    def following(self, style: str) -> str:
        node = self.nodes.get(style)
        return "" if node is None else _value(node.find(f"{_NS}next"))


class _Walk:
    def __init__(self, styles: Styles):
        self.styles = styles
        self.pages: list[list[Run | Table]] = [[]]
        self.numbers: dict[tuple[int, int], int] = {}

    def _break(self) -> None:
        if self.pages[-1]:
            self.pages.append([])

    def blocks(self, parent: ElementTree.Element, out: list[Run | Table] | None = None) -> None:
        """Paragraphs and tables of a body or a cell; ``out`` is a cell, which knows no pages."""
        style = self.styles.default
        for node in parent:
            kind = node.tag.removeprefix(_NS)
            if kind == "p":
                style = self.paragraph(node, style, out)
            elif kind == "tbl":
                table = self.table(node)
                target = self.pages[-1] if out is None else out
                target += [Run("\n"), table, Run("\n")]
            elif kind in ("sdt", "sdtContent", "ins", "smartTag", "customXml"):
                self.blocks(node, out)

    def paragraph(self, node: ElementTree.Element, style: str, out: list[Run | Table] | None) -> str:
        properties = node.find(f"{_NS}pPr")
        named = None if properties is None else properties.find(f"{_NS}pStyle")
        style = style if named is None else _value(named)
        base = self.styles.look(style)
        target = self.pages[-1] if out is None else out
        if target:
            target.append(Run("\n"))
        numbering = None if properties is None else properties.find(f"{_NS}numPr")
        numbering = self.styles.numbering(style) if numbering is None else numbering
        lead = ""
        if numbering is not None:
            level = _number(_value(numbering.find(f"{_NS}ilvl"), "0"), 0)
            list_id = _number(_value(numbering.find(f"{_NS}numId"), "-1"), -1)
            lead = "\t" * level
            if list_id > 0:
                n = self.numbers.get((list_id, level), 1)
                self.numbers[list_id, level] = n + 1
                for key in [k for k in self.numbers if k[0] == list_id and k[1] > level]:
                    del self.numbers[key]  # deeper levels count anew
                lead += f"{n}. "
        for run in node.iter(f"{_NS}r"):
            look = _look(run.find(f"{_NS}rPr")).over(base)
            size = -1 if look.size is None else look.size
            for part in run:
                kind = part.tag.removeprefix(_NS)
                target = self.pages[-1] if out is None else out
                if kind == "t" and part.text:
                    text = part.text if part.attrib.get(_SPACE) == "preserve" else part.text.strip()
                    if lead:
                        target.append(Run(lead, size, bool(look.bold)))
                        lead = ""
                    target.append(Run(text, size, bool(look.bold)))
                elif kind == "tab":
                    target.append(Run("\t"))
                elif kind == "br" and part.attrib.get(f"{_NS}type") == "page" and out is None:
                    self._break()
                elif kind in ("br", "cr") and part.attrib.get(f"{_NS}type", "textWrapping") == "textWrapping":
                    target.append(Run("\n"))
                elif kind == "lastRenderedPageBreak" and out is None:
                    self._break()
        return self.styles.following(style) or style

    def table(self, node: ElementTree.Element) -> Table:
        table = Table()
        for row in node.findall(f"{_NS}tr"):
            cells: list[list[Run]] = []
            for cell in row.findall(f"{_NS}tc"):
                content: list[Run | Table] = []
                self.blocks(cell, content)
                span = _number(_value(cell.find(f"{_NS}tcPr/{_NS}gridSpan"), "1"), 1)
                flat = [r for c in content for r in ([c] if isinstance(c, Run) else _flat(c))]
                cells += [flat] * max(1, span)
            if cells:
                table.rows.append(cells)
        return table


def _flat(table: Table) -> list[Run]:
    """A table inside a cell, as text."""
    out: list[Run] = []
    for row in table.rows:
        for cell in row:
            out += [*cell, Run(" ")]
        out.append(Run("\n"))
    return out


def _escape(text: str) -> str:
    return text.replace("*", r"\*")


def _cell(runs: list[Run]) -> str:
    out, bold = "", False
    for r in runs:
        if r.size >= 0 or r.text.strip():
            if r.bold != bold and r.text.strip():
                out += "**"
                bold = r.bold
        out += _escape(r.text)
    out += "**" if bold else ""
    return out.strip().replace("|", r"\|").replace("\n", "<br>")


def tidy(page: str) -> str:
    """Surplus breaks, spaces, dots and bold marks go."""
    page = page.replace("**\n", "**\n\n").replace("\n**", "\n\n**")
    page = re.sub("\n\n+", "\n\n", page).strip("\n")
    page = re.sub(r"\.\.\.+", "...", page)
    page = re.sub(" +", " ", page)
    for old, new in ((" **\n", "**\n"), ("# ** ", "# **"), ("# **\t", "# **"), ("** **", " "), ("**\t**", "\t"), ("**\n**", "\n"), ("****", "")):
        page = page.replace(old, new)
    return page


def markdown(pages: list[list[Run | Table]]) -> list[str]:
    """Pages with headings where a page's font is larger than the text's, bold marks, and pipe tables."""
    chars: dict[float, int] = {}
    for page in pages:
        for r in page:
            if isinstance(r, Run) and r.size >= 0:
                chars[r.size] = chars.get(r.size, 0) + len(r.text)
    levels = heading_levels(chars)
    out = []
    for page in pages:
        text, bold, level = "", False, 4
        for r in page:
            if isinstance(r, Table):
                text += "**" if bold else ""
                bold = False
                if r.rows:
                    rows = ["|" + "|".join(_cell(c) for c in row) + "|" for row in r.rows]
                    rows.insert(1, "|" + "-------|" * len(r.rows[0]))
                    text += "\n" + "\n".join(rows) + "\n\n"
                continue
            if r.size >= 0 and levels[r.size] != level:
                text += ("**" if bold else "") + "\n\n"
                level, bold = levels[r.size], False
                text += "#" * level + " " if level < 4 else ""
            if r.bold != bold:  # breaks and tabs are never bold
                text += "**"
                bold = r.bold
            text += _escape(r.text).replace("|", r"\|")
        text += "**" if bold else ""
        out.append(tidy(text))
    return out


def parse_docx(content: bytes) -> list[str]:
    """Markdown pages of a .docx file; pages are those of its last rendering, as far as it tells them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_NS}body")
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else None
    walk = _Walk(Styles(styles))
    if body is not None:
        walk.blocks(body)
    return markdown(walk.pages)
