import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from skeinlake.functions import salvage, text as T
from skeinlake.operators import chunking


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "pages, size, want",
    [
        (["# A\n\n## B\n\nbody1\n\nbody2", "body3\n\n## C\n\nbody4"], 4096, [("A", "B", "", "body1\n\nbody2\n\nbody3", [0, 1]), ("A", "C", "", "body4", [1])]),
        (["aaaaaa\n\nbbbb\n\nc"], 10, [("", "", "", "aaaaaa\n\nbbbb", [0]), ("", "", "", "c", [0])]),
        (["# A\n\n# B\n\nx"], 4096, [("A B", "", "", "x", [0])]),
        (["## A\n\n### B\n\n## C\n\nx"], 4096, [("", "C", "", "x", [0])]),
        (["# Title\nall one section"], 4096, []),
        ([""], 4096, [("", "", "", "", [0])]),
        ([], 4096, []),
    ],
)
def test_chunker_golden(pages, size, want):
    got = [(c["h1"], c["h2"], c["h3"], c["body"], c["ref"]) for c in chunking.split_pages(pages, size)]
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bbbb", "# h", "## i", "### j", "cc cc", ""]), max_size=8).map("\n\n".join), max_size=4), st.integers(1, 12))
def test_chunker_keeps_all_bodies(pages, size):
    chunks = chunking.split_pages(pages, size)
    bodies = [s for p in pages for s in p.split("\n\n") if not s.startswith(("# ", "## ", "### "))]
    assert [s for c in chunks for s in c["body"].split("\n\n")] == bodies
    for c in chunks:
        parts = c["body"].split("\n\n")
        assert len(parts) == 1 or len("\n\n".join(parts[:-1])) + len(parts[-1]) <= size
        assert c["ref"] == sorted(set(c["ref"]))


def test_chunk_documents(spark):
    df = spark.createDataFrame([("d1", ["# A\n\n## B\n\nbody1", "body3\n\n## C\n\nbody4"]), ("d2", None), ("d3", [])], "doc_id string, pages array<string>")
    got = chunking.chunk_documents(df).orderBy("chunk_no").collect()
    assert [(r.doc_id, r.chunk_no, r.content, r.page_hint) for r in got] == [
        ("d1", 0, "# A\n\n## B\n\nbody1\n\nbody3", "Pages (1-2)"),
        ("d1", 1, "# A\n\n## C\n\nbody4", "Page (2)"),
    ]


def test_heading_levels():
    assert chunking.heading_levels({10: 900, 14: 60, 18: 40}) == {10: 4, 14: 3, 18: 2}
    assert chunking.heading_levels({}) == {}
    assert chunking.heading_levels({12: 100}) == {12: 4}


def test_keys_and_cleanup(spark):
    assert one(spark, T.canonical_key(F.lit("Foo b#1/x [y]"))) == "Foo_b1x_[y]"
    assert one(spark, T.canonical_key(T.transliterate(F.lit("Müller & Söhne")))) == "Mueller_and_Soehne"
    assert one(spark, T.display_label(F.lit("a_b"))) == "a b"
    assert one(spark, T.clean_text(F.lit("  a....  b\n\n\n c \n"))) == "a... b\nc"
    assert one(spark, T.clean_paragraphs(F.lit("a\n\n\n\nb\n c"))) == "a\n\nb\nc"
    assert one(spark, T.chunk_label(F.lit("f.pdf"), F.lit("**T**"))) == "f.pdf - T"
    assert one(spark, T.chunk_label(F.lit("f.pdf"), F.lit(""))) == "f.pdf"
    assert one(spark, T.type_of_id(F.lit("Node/x/y"))) == "Node"
    assert one(spark, T.community_key(F.lit(1), F.lit(23))) == "00001/00023"
    assert one(spark, T.json_bounds(F.lit('so {"a": {"b": 1}} end'))) == '{"a": {"b": 1}}'
    assert T.community_column(7) == "community_007"


def test_salvage_summary(spark):
    good = '{"label": "A label", "description": "A long enough description"}'
    assert one(spark, T.salvage_summary(F.lit("x " + good + " y"))).label == "A label"
    broken = '"label": "A label", "description": "A long enough "quoted" description"'
    assert one(spark, T.salvage_summary(F.lit(broken))).description == 'A long enough "quoted" description'
    assert one(spark, T.salvage_summary(F.lit('{"label": "A", "description": "A long enough description"}'))) is None
    assert one(spark, T.salvage_summary(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(
    "text, want",
    [
        ('[{"From": "A", "To": "B", "Relation": "r"}]', [("A", "B", "r")]),
        ("[{'From': 'A', 'To': 'B', 'Relation': 'r'}]", [("A", "B", "r")]),
        ('Sure! [{"From": "Ä", "To": "B & C", "Relation": "r"}] done', [("Ae", "B and C", "r")]),
        ('{"From": "A", "To: "B", "Relation": "r"} {"From": "C", "To": "D", "Relation": "s"}', [("A", "B", "r"), ("C", "D", "s")]),
        ('[{"From": "A", "To": "B", "Relation": "r", "From": "C", "To": "D", "Relation": "s"', [("A", "B", "r"), ("C", "D", "s")]),
        ('[{"From": "A", "To": "B"}]', []),
        ("__import__('os').system('true')", []),
        ("", []),
        (None, []),
    ],
)
def test_salvage_relations(text, want):
    assert [(t["From"], t["To"], t["Relation"]) for t in salvage.salvage_relations(text)] == want


def test_relations_column(spark):
    raw = [json.dumps([{"From": "A", "To": "B", "Relation": "r"}]), "{From: C, To: D, Relation: s}", None, "nothing"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = {r.i: [tuple(t) for t in (r.x or [])] for r in df.select("i", salvage.relations_of(F.col("raw")).alias("x")).collect()}
    assert got == {0: [("A", "B", "r")], 1: [("C", "D", "s")], 2: [], 3: []}
