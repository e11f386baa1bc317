import pytest

from skeinlake.sources.tables import Warehouse


def test_upsert_and_update(spark, tmp_path):
    t = Warehouse(spark, str(tmp_path / "w"))
    frame = lambda rows, schema="id int, name string, n int": spark.createDataFrame(rows, schema)
    t.upsert("x", frame([(1, "a", 1), (2, "b", 2)]), ("id",))
    t.upsert("x", frame([(2, "c", 3), (3, "d", None)]), ("id",))
    rows = lambda: sorted((r.id, r.name, r.n) for r in t.read("x").collect())
    assert rows() == [(1, "a", 1), (2, "c", 3), (3, "d", None)]
    t.update("x", frame([(1, 9), (2, None), (7, 5)], "id int, n int"), ("id",))
    assert rows() == [(1, "a", 9), (2, "c", 3), (3, "d", None)]
    for bad in ([(1, "a", 1), (1, "b", 1)], [(None, "a", 1)]):
        with pytest.raises(ValueError):
            t.upsert("x", frame(bad), ("id",))
    assert rows() == [(1, "a", 9), (2, "c", 3), (3, "d", None)]
    assert t.duplicates(frame([(1, "a", 1), (1, "b", 1), (2, "c", 1)]), ("id",)).collect()[0].n == 2
