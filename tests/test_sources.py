import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from skeinlake.sources import docx, files, pdf, tables
from skeinlake.streaming import ingest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def make_docx(body, styles=""):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}"><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="22"/></w:rPr></w:rPrDefault></w:docDefaults>{styles}</w:styles>')
    return buffer.getvalue()


def p(text, props="", run=""):
    return f'<w:p>{props}<w:r><w:rPr>{run}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'


def test_docx():
    styles = (
        '<w:style w:type="paragraph" w:styleId="Base"><w:rPr><w:b/></w:rPr></w:style>'
        '<w:style w:type="paragraph" w:styleId="Title"><w:basedOn w:val="Base"/><w:next w:val="Body"/><w:rPr><w:sz w:val="40"/></w:rPr></w:style>'
    )
    numbered = '<w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr></w:pPr>'
    cell = lambda t, span="": f"<w:tc><w:tcPr>{span}</w:tcPr>{p(t)}</w:tc>"
    body = (
        p("The title", '<w:pPr><w:pStyle w:val="Title"/></w:pPr>')
        + p("Some body text that is long enough to be the main size of this document, a*b.")
        + p("first", numbered)
        + p("second", numbered)
        + p("loud", "", "<w:b/>")
        + f"<w:tbl><w:tr>{cell('h1')}{cell('h2')}</w:tr><w:tr>{cell('wide', '<w:gridSpan w:val=\"2\"/>')}</w:tr></w:tbl>"
        + '<w:p><w:r><w:br w:type="page"/><w:t>next page</w:t></w:r></w:p>'
    )
    pages = docx.parse_docx(make_docx(body, styles))
    assert len(pages) == 2
    assert pages[0].startswith("### **The title**")
    assert "1. first" in pages[0] and "2. second" in pages[0] and "**loud**" in pages[0] and r"a\*b" in pages[0]
    assert "|h1|h2|\n|-------|-------|\n|wide|wide|" in pages[0]
    assert pages[1] == "next page"


def make_pdf(pages, compress=True, fonts=("Helvetica", "Helvetica-Bold"), broken_xref=False):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    kids = []
    font_ids = []
    for f in fonts:
        objects.append(b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [%s] >>" % (f.encode(), b" ".join([b"500"] * 224)))
        font_ids.append(len(objects))
    res = b"<< /Font << " + b" ".join(b"/F%d %d 0 R" % (i, n) for i, n in enumerate(font_ids)) + b" >> >>"
    for content in pages:
        data = zlib.compress(content) if compress else content
        objects.append(b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if compress else b"", data))
        objects.append(b"<< /Type /Page /Parent 2 0 R /Resources %s /Contents %d 0 R >>" % (res, len(objects)))
        kids.append(len(objects))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    at = len(out) + (7 if broken_xref else 0)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % x for x in places)
    return out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, at)


TEXT = (
    b"BT /F1 20 Tf 72 720 Td (Heading) Tj ET\n"
    b"BT /F0 10 Tf 72 690 Td 12 TL (This is the first line of a para-) Tj T* (graph of plain text with \\344 sign.) Tj ET\n"
    b"BT /F0 10 Tf 72 640 Td [(Kerned) -600 (words) -50 (.)] TJ ET"
)


@pytest.mark.parametrize("compress, broken", [(True, False), (False, True)])
def test_pdf(compress, broken):
    pages = pdf.parse_pdf(make_pdf([TEXT, b"BT /F0 10 Tf 72 700 Td (Second page) Tj ET"], compress, broken_xref=broken))
    assert len(pages) == 2 and pages[1] == "Second page"
    assert pages[0].split("\n\n")[0] == "### **Heading**"
    assert "first line of a paragraph of plain text with ä sign." in pages[0]
    assert "Kerned words." in pages[0]


def test_pdf_table():
    grid = b"".join(b"%d 600 m %d 660 l S\n" % (x, x) for x in (72, 172, 272)) + b"".join(b"72 %d m 272 %d l S\n" % (y, y) for y in (600, 630, 660))
    cells = b"".join(b"BT /F0 10 Tf %d %d Td (%s) Tj ET\n" % (x, y, t) for x, y, t in ((80, 640, b"a"), (180, 640, b"b"), (80, 610, b"c"), (180, 610, b"d|e")))
    above = b"BT /F0 10 Tf 72 700 Td (Above the table) Tj ET\n"
    page = pdf.parse_pdf(make_pdf([above + grid + cells]))[0]
    assert page == "Above the table\n\n|a|b|\n|-------|-------|\n|c|d\\|e|"


def test_pdf_streams():
    """Cross-reference stream with a predictor, object stream, ToUnicode map."""
    cmap = b"1 beginbfchar <41> <00DC> endbfchar 1 beginbfrange <42> <43> <0078> endbfrange"
    inner = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>"), (3, b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R /Resources << /Font << /F 4 0 R >> >> >>"), (4, b"<< /Type /Font /Subtype /TrueType /BaseFont /X /ToUnicode 7 0 R >>")]
    heads, body = b"", b""
    for n, o in inner:
        heads += b"%d %d " % (n, len(body))
        body += o + b" "
    packed = zlib.compress(heads + body)
    out, places = b"%PDF-1.5\n", {}
    streams = {5: (b"/Type /ObjStm /N 4 /First %d /Filter /FlateDecode" % len(heads), packed), 6: (b"", b"BT /F 10 Tf 10 10 Td <414243> Tj ET"), 7: (b"", cmap)}
    for n, (head, data) in streams.items():
        places[n] = len(out)
        out += b"%d 0 obj << %s /Length %d >> stream\n%s\nendstream endobj\n" % (n, head, len(data), data)
    places[8] = len(out)
    rows = [bytes([0, 0, 0, 0])] + [bytes([2, 0, 5, i]) for i in range(4)] + [bytes([1]) + places[n].to_bytes(2, "big") + b"\0" for n in (5, 6, 7, 8)]
    before, coded = bytes(4), b""
    for r in rows:
        coded += b"\x02" + bytes((a - b) & 255 for a, b in zip(r, before))
        before = r
    data = zlib.compress(coded)
    out += b"8 0 obj << /Type /XRef /Size 9 /W [1 2 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> /Length %d >> stream\n%s\nendstream endobj\nstartxref\n%d\n%%%%EOF" % (len(data), data, places[8])
    assert pdf.parse_pdf(out) == ["Üxy"]


def test_pdf_errors():
    with pytest.raises(pdf.PdfError):
        pdf.parse_pdf(b"hello")
    with pytest.raises(pdf.PdfError, match="encrypted"):
        pdf.parse_pdf(make_pdf([TEXT]).replace(b"/Root 1 0 R >>", b"/Root 1 0 R /Encrypt << >> >>"))


def make_zip(entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return buffer.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("files")
    (base / "a.txt").write_text("# Head\n\nBody  of Alice likes Bob....\n\n\nmore", encoding="utf-8")
    (base / "~$a.txt").write_text("temporary")
    (base / "b.bin").write_bytes(b"\0")
    (base / "c.pdf").write_bytes(b"not a pdf")
    (base / "sub").mkdir()
    (base / "sub" / "d.MD").write_bytes("caf\xe9".encode("cp1252"))
    inner = make_zip({"deep.txt": "deep text"})
    (base / "e.zip").write_bytes(make_zip({"x/f.txt": "Zipped text", "../evil.txt": "out", "in.zip": inner, "bad.zip": b"PK"}))
    return base


def test_files(spark, folder):
    pages, errors = files.load_documents(spark, str(folder))
    got = {r.file: r.pages for r in pages.collect()}
    assert got == {"a.txt": ["# Head\n\nBody of Alice likes Bob...\n\nmore"], "d.MD": ["café"], "f.txt": ["Zipped text"], "deep.txt": ["deep text"]}
    said = {r.path.rsplit("/", 1)[1]: r.error for r in errors.collect()}
    assert "unsupported type .bin" in said["b.bin"] and "not a PDF" in said["c.pdf"]
    assert any("leads out" in e for e in said.values()) and any("bad archive" in e for e in said.values())
    assert files.parse_text(b"a\n\nb", keep_paragraphs=False) == ["a\nb"]


def test_manifest(spark, folder):
    listing = files.list_files(spark, str(folder)).select("path", "modificationTime")
    known = listing.where(F.col("path").endswith("a.txt"))
    pages, _ = files.load_documents(spark, str(folder), known)
    assert "a.txt" not in {r.file for r in pages.collect()}


def test_safe_member():
    assert files.safe_member("a/../b.txt") == "b.txt"
    for bad in ("../b", "/etc/x", "C:\\x", "a/", "a/../../b"):
        assert files.safe_member(bad) is None


def test_archive_limit(monkeypatch):
    monkeypatch.setattr(files, "MAX_UNPACKED", 10)
    got = list(files.members("x.zip", make_zip({"a.txt": "123456", "b.txt": "1234567"})))
    assert got[0] == ("x.zip!a.txt", b"123456", None) and got[1][2] == "archive too large"


def test_warehouse(spark, tmp_path):
    w = tables.Warehouse(spark, str(tmp_path / "w"))
    assert w.names() == []
    t = w.write("t", spark.range(5))
    w.write("t", t.where("id > 1"))  # rewritten from itself
    assert w.read("t").count() == 3 and w.names() == ["t"]
    w.write("t", spark.range(2), mode="append")
    w.create_if_missing("u", "id bigint")
    assert w.count("t", "u") == 5
    assert w.query("SELECT count(*) AS n FROM t WHERE id > :low", low=1).first().n == 3
    w.write("p", spark.range(6).withColumn("d", F.col("id") % 2), ("d",))
    assert w.read("p").where("d = 1").count() == 3
    w.drop("t")
    assert not w.exists("t")


def test_union_and_schema(spark):
    a = spark.createDataFrame([(["L", "Searchable"], {"x": "1", "SearchableKey": "2"})], "labels array<string>, props map<string,string>")
    b = spark.createDataFrame([(["M"],)], "labels array<string>")
    got = {(r.label, r.property): r.n for r in tables.structured_schema(tables.union_all(a, b)).collect()}
    assert got == {("L", "x"): 1, ("M", None): 1}


def test_streaming(spark, folder, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    ingest.ingest(spark, str(folder), out, checkpoint).awaitTermination()
    first = spark.read.parquet(f"{out}/chunks").count()
    assert first == 4 and spark.read.parquet(f"{out}/errors").count() >= 4
    ingest.ingest(spark, str(folder), out, checkpoint).awaitTermination()  # nothing is new
    assert spark.read.parquet(f"{out}/chunks").count() == first
    (folder / "later.txt").write_text("later")
    ingest.ingest(spark, str(folder), out, checkpoint).awaitTermination()
    assert spark.read.parquet(f"{out}/chunks").count() == first + 1


def test_sessions(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "user_id int, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    assert sorted((r.user_id, r.events) for r in ingest.sessions(events).collect()) == [(1, 1), (1, 2), (2, 1)]
