import pytest

from skeinlake.plans.api import Engine, retrieve
from skeinlake.operators.ranking import NO_DOCUMENTS


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    base = tmp_path_factory.mktemp("library")
    (base / "people.md").write_text("# People\n\nAlice knows Bob. Bob likes Carol. Carol visits Alice.\n\n# Places\n\nAlice lives in Berlin. Dora stays in Rome.")
    (base / "animals.txt").write_text("Rex chases Tom. Tom fears Rex. Tom sees Alice.")
    return str(base)


@pytest.fixture(scope="module")
def warehouse(spark, library, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warehouse"))
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    Engine(spark, folder, "influence", "influence").index(library)
    return folder


def test_tables(spark, warehouse):
    e = Engine(spark, warehouse, "influence", None)
    t = e.tables
    assert t.read("chunks").count() == 3 and t.read("errors").count() == 0
    entities = {r.entity: r.weight for r in t.read("entities").collect()}
    assert {"Alice", "Bob", "Carol", "Rex", "Tom"} <= set(entities)
    assert round(sum(entities.values()), 6) == 3
    assert t.read("community_vectors").count() >= 1
    assert t.read("communities").where("content IS NULL").count() == 0


@pytest.mark.parametrize("name", ["influence", "community", "chunk", "global"])
def test_query(spark, warehouse, name):
    rows = Engine(spark, warehouse, "influence", name).query("Who knows Alice and Bob", confidence_cutoff=0).collect()
    assert rows and rows[0].name != NO_DOCUMENTS


def test_incremental(spark, warehouse, library):
    e = Engine(spark, warehouse, "influence", None)
    e.load(library)
    assert e.tables.read("chunks").count() == 3


def test_graph_indexers(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "g"), "graph_hybrid", "graph_hybrid_expansion")
    nodes = [("1", ["Person"], {"name": "Ada", "job": "mathematics"}), ("2", ["Person"], {"name": "Bo", "job": "baking"})]
    e.tables.write("nodes", spark.createDataFrame(nodes, "id string, labels array<string>, props map<string,string>"))
    e.tables.write("edges", spark.createDataFrame([("1", "2", "knows")], "src string, dst string, label string"))
    e.index()
    got = e.query("mathematics", "SELECT h.id, e.dst FROM hits h JOIN edges e ON e.src = h.id").collect()
    assert [(r.id, r.dst) for r in got] == [("1", "2")]
    plain = Engine(spark, str(tmp_path / "g"), "graph_hybrid", "graph_vector").query("label: Person ; job: baking ; name: Bo", top_k=1)
    assert plain.first().id == "2"
    assert "baking" in Engine(spark, str(tmp_path / "g"), "graph_hybrid", "graph_hybrid").answer("baking")["answer"]


def test_request(spark, warehouse):
    e = Engine(spark, warehouse, "influence", "chunk")
    rows = retrieve(e, {"latestUserPrompt": "Alice", "latestUserPromptType": "text", "parameters": {"confidence_cutoff": "0.0", "nope": "1"}, "maxMatches": 2}).collect()
    assert len(rows) == 2
    with pytest.raises(ValueError):
        retrieve(e, {"latestUserPrompt": "x", "latestUserPromptType": "image"})
    with pytest.raises(ValueError):
        Engine(spark, warehouse, "chunk", "global")


def test_edited_files_and_reused_summaries(spark, tmp_path):
    import os

    class Counting:
        """A summarizer that leaves a line in a file for each call."""

        def __init__(self, path):
            self.path = path

        def summarize(self, text):
            from skeinlake.providers import LeadSummarizer

            with open(self.path, "a") as f:
                f.write("call\n")
            return LeadSummarizer().summarize(text)

    folder, calls = tmp_path / "files", tmp_path / "calls"
    folder.mkdir()
    calls.touch()
    (folder / "a.md").write_text("# People\n\nAlice knows Bob. Bob likes Carol. Carol visits Alice.")
    (folder / "b.txt").write_text("Rex chases Tom. Tom fears Rex.")
    e = Engine(spark, str(tmp_path / "w"), "influence", None, summarizer=Counting(str(calls)))
    e.index(str(folder))
    first = len(calls.read_text())
    assert first > 0
    e.index(str(folder))
    assert len(calls.read_text()) == first  # nothing changed, so no summary is asked for again
    before = {r.chunk_id for r in e.tables.read("chunks").collect()}
    (folder / "b.txt").write_text("Rex chases Kim. Kim fears Rex.")
    os.utime(folder / "b.txt", (2_000_000_000, 2_000_000_000))
    e.index(str(folder))
    chunks = e.tables.read("chunks").collect()
    assert len(chunks) == len({r.chunk_id for r in chunks}) == 2 and {r.chunk_id for r in chunks} != before
    assert not any("Tom" in r.content for r in chunks)
    entities = {r.entity for r in e.tables.read("entities").collect()}
    assert "Kim" in entities and "Tom" not in entities and "Alice" in entities


def test_interrupted_load(spark, tmp_path):
    """Chunks written before the manifest don't come twice."""
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.txt").write_text("Rex chases Tom.")
    e = Engine(spark, str(tmp_path / "w"), "chunk", None)
    e.load(str(folder))
    e.tables.drop("manifest")
    e.load(str(folder))
    assert e.tables.read("chunks").count() == 1


def test_node_properties(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "g"), "graph_vector", "graph_vector")
    nodes = [("1", ["Film"], {"name": "Ada", "year": "1999"}), ("2", ["Film"], {"name": "Bo", "year": "2010"}), ("3", ["Film"], {"name": "Cy"})]
    e.tables.write("nodes", spark.createDataFrame(nodes, "id string, labels array<string>, props map<string,string>"))
    e.index()
    got = e.query("film", filters={"year": {"$gte": 2000}}, return_properties=("name", "year"), top_k=5).collect()
    assert [(r.id, r.name, r.year) for r in got] == [("2", "Bo", "2010")]
    got = e.query("film", filters={"$or": [{"name": "Cy"}, {"year": {"$in": [1999]}}]}, top_k=5).collect()
    assert {r.id for r in got} == {"1", "3"}


def test_names_of_expressions(spark):
    from skeinlake.operators.text_to_query import check_sql, checked_query

    spark.range(3).createOrReplaceTempView("secret")
    hiding = "SELECT id FROM secret UNION ALL SELECT * FROM (WITH secret AS (SELECT 1L) SELECT * FROM secret)"
    for sql in (hiding, "WITH ok AS (SELECT * FROM secret) SELECT * FROM ok", "SELECT * FROM secret"):
        with pytest.raises(ValueError):
            check_sql(spark, sql, {"ok"})
    spark.range(7).createOrReplaceTempView("hits")
    assert checked_query(spark, "WITH x AS (SELECT id FROM hits) SELECT count(*) AS n FROM x", {"hits": spark.range(2)}).first().n == 2
    assert spark.table("hits").count() == 7
    spark.catalog.dropTempView("secret")
    spark.catalog.dropTempView("hits")
