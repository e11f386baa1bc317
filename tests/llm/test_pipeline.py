"""The stages against brute force, on a table with planted cases."""

import random
import re

import pytest

import corpus_pipeline as P
from test_near import brute as near_brute
from test_repeats import brute as repeat_brute, tokens

LEAK = "the quick benchmark question asks which metal melts at the lowest temperature of all known elements today"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("sf")
    r = random.Random(12)
    text = lambda n: " ".join("".join(r.choices(["an", "ti", "er", "ha", "sto", "we"], k=r.randrange(1, 4))) + (f"{r.randrange(99)}" if r.random() < 0.2 else "") for _ in range(n))
    rows = [(i, text(r.randrange(60, 200)), "en", f"s{i % 2}") for i in range(150)]
    passage = text(65)
    rows += [(200 + i, f"{text(40)} {passage} {text(40)}", "en", "s0") for i in range(3)]
    rows += [(300 + i, rows[i][1], "en", "s1") for i in range(5)]
    rows += [(400 + i, rows[10 + i][1].replace("an", "AN", 1) + " extra", "en", "s1") for i in range(5)]
    rows += [(500 + i, f"{text(40)} {LEAK} {text(30)}", "en", "s1") for i in range(3)]
    rows += [(600 + i, " ".join(w + "%%%" for w in text(80).split()), "en", "s0") for i in range(8)]
    rows += [(700, None, None, None), (701, "", "en", "s0"), (None, text(30), "en", "s0")]
    full = [(*x, len(x[1]) if x[1] is not None else None) for x in rows]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, LEAK)], "item_id bigint, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        if i < len(P.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = [(r.doc_id, r.text) for r in docs.collect()] if "text" in docs.columns else docs.collect()
        after = dict(seen[name]) if "text" in docs.columns else None
        if name == "quality_rules":
            assert {i for i, _ in before} - set(after) == {600 + k for k in range(8)}
        elif name == "near_duplicates":
            assert {i for i in after if i is not None} == {i for i in near_brute(before, 0.55) if i is not None}
            assert not {300 + k for k in range(5)} & set(after) and not {400 + k for k in range(5)} & set(after)
        elif name == "substring_dedup":
            left = repeat_brute(before)
            for d, t in before:
                if d is not None and t is not None and tokens(t) and left[d]:
                    assert tokens(after[d]) == left[d]
            assert len(tokens(after[201])) == 80 and len(tokens(after[200])) == 145
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None)
        elif name == "decontamination":
            assert all("benchmark" not in (t or "") for _, t in after.items())
            assert all(after[d] == t for d, t in before if d not in (500, 501, 502))
        elif name == "packing":
            total = {}
            for r in seen[name]:
                total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
            assert total == {d: len(tokens(t)) for d, t in before if d is not None and tokens(t)}


def test_run(spark, folder):
    rows = P.run(spark, folder).collect()
    kept = {r.doc_id for r in rows}
    assert not {x for x in kept if 300 <= x < 500 or 600 <= x < 700} and {0, 200, 201, 500} <= kept


def test_empty_tables_repeated_rows_and_clashing_columns(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    for name, table, items in (("empty", docs.limit(0), benchmark), ("twice", docs.where("doc_id < 40").unionByName(docs.where("doc_id < 40")), benchmark.limit(0))):
        table = table.selectExpr("*", "1 AS removed_tokens", "2 AS start", "'x' AS bucket", "3 AS keeper", "4 AS g", "5 AS n", "6 AS row")
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        table = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for k, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, table, f"{tmp_path}/{name}")
            if k < len(P.STAGES) - 1:
                assert out.columns == table.columns
            out.write.parquet(f"{tmp_path}/{name}/{k}")
            table = spark.read.parquet(f"{tmp_path}/{name}/{k}")
        rows = table.collect()
        assert not rows if name == "empty" else {r.doc_id for r in rows} == set(range(40)) and len(rows) == 80


def test_shape_of_contract():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    assert P.ORACLE_SQL is None and re.match("All stages", P.run.__doc__)
