"""The owners of a pivot come out of the rows it groups, not out of a join."""

from bomspark.operators import aggs as A
from bomspark.plans import QUERIES

from test_plain_rows import plan_of, tables


def test_pivot_gives_its_owners(spark):
    rows = [(1, "/a", "x", 0, "tier", "t"), (1, "/a", "x", 2, "lot", "l"), (1, "/a", "x", 0, "tier", "t"), (1, "/a", "x", 2, "lot", "l"), (1, "/b", None, 1, "lot", "m"), (1, "/c", "z", 0, "other", "o")]
    props = spark.createDataFrame(rows, "bom_id long, owner_pointer string, owner_ref string, position int, name string, value string")
    got = sorted(map(tuple, A.property_pivot(props, ["tier", "lot"], with_refs=True).collect()))
    assert got == [(1, "/a", "x", "t|t", "l|l"), (1, "/a", "x", "t|t", "l|l"), (1, "/b", None, "", "m")]
    assert A.property_pivot(props, ["tier"]).columns == ["bom_id", "owner_pointer", "tier"]


def test_pivot_moves_no_elements(spark, tmp_path):
    tables(spark, tmp_path, [(1, 1, 1, "A"), (1, 2, 2, "A"), (2, 1, 7, "A")])
    got = QUERIES["property_pivot"](spark, str(tmp_path))
    assert "owner_pointer" not in "".join(l for l in plan_of(got).split("\n") if "Exchange" in l)
    assert sorted((r.bom_id, r.owner_ref, r.lot) for r in got.collect()) == [(1, "c-1", "1|1"), (1, "c-1", "1|1"), (1, "c-2", "2|2"), (1, "c-2", "2|2"), (2, "c-7", "1")]
