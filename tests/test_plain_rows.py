"""Plain rows are grouped, not the texts made of them."""

import datetime as dt
import json
import re

from bomspark.plans import corpus as C
from bomspark.plans.derived import Tables


def tables(spark, path, lines):
    day = dt.datetime(2024, 1, 1)
    rows = [(o, p, p, n, 5.0, 0.1, 0.02, flag, "O", day) for o, p, n, flag in lines]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(1, "p 1", "B#1", "PROMO", 3), (2, "p 2", "B#2", "SMALL", 4)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([(1, 7, "O", day, "5-LOW"), (1, 7, "O", day, "5-LOW"), (2, 7, "F", day, "4-X")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    return Tables(spark, str(path))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_declarations_group_plain_rows(spark, tmp_path):
    t = tables(spark, tmp_path, [(1, 2, 2, "R"), (1, 1, 1, "A"), (1, 2, 1, "A"), (2, 1, None, "A"), (2, 1, None, "A")])
    docs = C.declaration_docs(t)
    plan = plan_of(docs)
    grouped = plan[plan.index("ObjectHashAggregate"):]
    assert "to_json" not in grouped and len(re.findall(r"Exchange", grouped)) == 1, plan
    one, two = (json.loads(r.content)["declarations"] for r in docs.orderBy("bom_id").collect())
    assert [(m["requirement"], "claims" in m) for m in one["attestations"][0]["map"]] == [("r-1", True), ("r-2", True), ("r-2", False)]
    assert [k["bom-ref"] for k in one["claims"]] == ["k-1", "k-2"] and [e["bom-ref"] for e in one["evidence"]] == ["e-1", "e-2"]
    assert [a["bom-ref"] for a in one["assessors"]] == ["a-1", "a-2"]
    assert len(two["attestations"][0]["map"]) == 2 and len(two["claims"]) == 1 and "bom-ref" not in two["claims"][0]


def test_edges_are_told_apart_by_number(spark, tmp_path):
    t = tables(spark, tmp_path, [(1, 1, 2, "A"), (1, 2, 2, "A"), (1, 2, None, "A"), (1, 1, None, "A")])
    keys = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", plan_of(t.doc_edge_by_document))
    assert keys and all("l_linenumber" in k and "ref" not in k for k in keys)
    assert {tuple(r) for r in t.doc_edge.collect()} == {(1, "c-2", "c-3"), (1, None, None)} and t.doc_edge.count() == 2
