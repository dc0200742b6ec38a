"""Elements come out of one pass, and texts are made after the narrow rows have moved."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from bomspark.operators import flatten as X
from bomspark.plans import corpus as C, q_misc
from bomspark.plans.derived import Tables
from bomspark.session import shared_dir
from bomspark.sources.documents import typed, write_bom_json


def nested(depth: int) -> dict:
    c = {"type": "library", "bom-ref": f"c-{depth}", "name": "components"}
    for d in range(depth - 1, -1, -1):
        c = {"type": "library", "bom-ref": f"c-{d}", "name": "n", "components": [c, {"name": f"side-{d}"}]}
    return c


def docs_of(spark, *docs):
    return typed(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "bom_id long, content string"))


def test_elements_of_any_depth_without_files(spark):
    ancestor = {"name": "old", "bom-ref": "a", "components": [{"name": "inner"}], "pedigree": {"variants": [{"name": "twin"}]}}
    docs = docs_of(
        spark, {"components": [nested(30), {"name": "x", "pedigree": {"ancestors": [ancestor, 7]}}]}, {"components": "none"}, {},
        {"services": [{"name": "s", "bom-ref": "s", "services": [{"name": "t"}]}]},
    )
    folder = shared_dir(spark)
    before = set(os.listdir(folder))
    el = X.component_elements(docs, ("inventory",))
    services = X.service_elements(docs)
    rows = {r.pointer: r for r in el.select("pointer", "parent_pointer", "parent_ref", "depth", "role", "c.name").collect()}
    assert set(os.listdir(folder)) == before
    assert len(rows) == 31 + 30 + 1 + 2 + 2
    deep = "/components/0" + "/components/0" * 30
    assert (rows[deep].depth, rows[deep].parent_ref, rows[deep].parent_pointer) == (30, "c-29", deep.removesuffix("/components/0"))
    twin = rows["/components/1/pedigree/ancestors/0/pedigree/variants/0"]
    assert (twin.name, twin.role, twin.depth, twin.parent_ref) == ("twin", "variant", 2, "a")
    assert rows["/components/1/pedigree/ancestors/0/components/0"].role == "ancestor"
    assert rows["/components/1/pedigree/ancestors/1"].name is None
    assert [(r.pointer, r.depth, r.parent_ref) for r in services.orderBy("pointer").collect()] == [("/services/0", 0, None), ("/services/0/services/0", 1, "s")]


def test_texts_do_not_move(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    lines = [(o, p, p, n, 5.0, 0.1, 0.02, "A", "O", day) for o in (1, 2) for n, p in enumerate((1, 2, 1, 2, 1, 2), 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "p 1", "B#1", "PROMO", 3), (2, "p 2", "B#2", "SMALL", 4)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 7, "O", day, "5-LOW"), (2, 7, "F", day, "4-X")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    t = Tables(spark, str(tmp_path))
    makers = [lambda: C.component_docs(t, deps=True, comps=True), lambda: C.formulation_docs(t), lambda: C.evidence_docs(t), lambda: q_misc.plain_documents(t), lambda: q_misc.xml_text(t)]
    for make in makers:
        plan = make()._jdf.queryExecution().executedPlan().toString()
        assert "item" not in "".join(l for l in plan.split("\n") if "Exchange" in l)
        partial = plan[plan.index("collect_list"):]
        head = partial[: partial.rindex("collect_list")]
        assert "Exchange hashpartitioning(bom_id" not in head, plan
    got = json.loads(C.component_docs(t, deps=True, comps=True).filter("bom_id = 1").first().content)
    assert [c["bom-ref"] for c in got["components"]] == ["c-1", "c-2", "c-3", "b-1"]
    assert [d["ref"] for d in got["dependencies"]] == [f"c-{n}" for n in range(1, 7)] and len(got["compositions"]) == 6


def test_document_lines_are_packed(spark, tmp_path):
    write_bom_json(spark.range(3).select(F.format_string('{"version":%d}', "id").alias("content")), f"{tmp_path}/o")
    assert all(n.endswith(".gz") for n in os.listdir(f"{tmp_path}/o") if n.startswith("part-"))
    assert {r.value for r in spark.read.text(f"{tmp_path}/o").collect()} == {f'{{"version":{i}}}' for i in range(3)}


def test_shortest_paths_send_nothing_to_all(spark):
    from bomspark.operators import graph as G

    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    sent = []
    kept = G.cut
    G.cut = lambda df: (sent.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df))[1]
    try:
        rows = {r.node: (r.path, r.depth) for r in G.shortest_paths(edges, start).collect()}
    finally:
        G.cut = kept
    assert rows == {1: ("1", 0), 2: ("1>2", 1), 3: ("1>3", 1), 4: ("1>3>4", 2)}
    joins = [line for plan in sent for line in plan.split("\n") if "Join " in line]
    assert joins and all("strategy=merge" in line for line in joins)


def test_expiry_alert_takes_few_state_calls():
    import pandas as pd

    from bomspark.streaming.jobs import ExpiryAlerts

    calls, timers, held = [], [], {}

    class State:
        def exists(self):
            calls.append("exists")
            return "end" in held

        def get(self):
            calls.append("get")
            return held.get("end")

        def update(self, v):
            calls.append("update")
            held["end"] = v

    class Handle:
        def getValueState(self, name, schema):
            return State()

        def registerTimer(self, at):
            timers.append(at)

        def listTimers(self):
            return iter(list(timers))

        def deleteTimer(self, at):
            timers.remove(at)

    class Expired:
        def getExpiryTimeInMs(self):
            return timers[0]

    p = ExpiryAlerts(10)
    p.init(Handle())
    rows = lambda end: iter([pd.DataFrame({"end_ms": [end]})])
    list(p.handleInputRows((1,), rows(100), None))
    assert (calls, timers) == (["get", "update"], [90])
    list(p.handleInputRows((1,), rows(200), None))
    list(p.handleInputRows((1,), rows(150), None))
    assert timers == [190]
    n = len(calls)
    (alert,) = p.handleExpiredTimer((1,), None, Expired())
    assert alert.to_dict("list") == {"cert_id": [1], "end_ms": [200]} and len(calls) == n
    list(p.handleInputRows((1,), rows(200), None))
    assert timers == [190]
