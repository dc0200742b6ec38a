"""Tables read the members they take, XML levels come out of one parse, and tasks hold a bounded share of the lines."""

import json
import os

import pytest
from pyspark.sql import functions as F

from bomspark.model import doc_schema as D
from bomspark.operators import flatten as X
from bomspark.plans import derived
from bomspark.session import shared_dir
from bomspark.sources import xml_docs as XD
from bomspark.sources.documents import typed


def docs_of(spark, *docs):
    return typed(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "bom_id long, content string"))


def test_tables_of_taken_members(spark):
    docs = docs_of(spark, {"components": [{"name": "n", "bom-ref": "r", "swid": {"tagId": "t"}, "hashes": [{"alg": "MD5", "content": "x"}]}, 7]})
    el = X.component_elements(docs, ("inventory",))
    assert [r.name for r in X.flatten_components(el).orderBy("pointer").collect()] == ["n", None]
    assert [(r.owner_ref, r.tag_id, r.version) for r in X.swid_table(el).collect()] == [("r", "t", "0.0")]
    assert [(r.kind, r.value) for r in X.explode_identifiers(el).collect()] == [("swid", "t")]


def test_members_of_a_shape():
    names = [n for n, _ in X._fields(D.COMPONENT)]
    assert names[:3] == ["type", "mime-type", "bom-ref"] and names[-1] == "patentAssertions" and len(names) == len(set(names))


def xml(spark, folder, *texts):
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.text(folder + "/in")
    return XD.read_bom_xml_lines(spark, folder + "/in")


def component(depth, n=0):
    inner = f"<components>{component(depth, n + 1)}<component type='file'><name>side</name></component></components>" if n < depth else ""
    return f"<component type='library' bom-ref='c-{n}'><name>n-{n}</name>{inner}</component>"


def test_xml_levels_leave_no_files(spark, folder):
    docs = xml(
        spark, folder, f"<bom version='1'><components>{component(9)}</components></bom>",
        "<bom version='1'><metadata><component type='library'><name>m</name></component></metadata><services><service bom-ref='s'><name>s</name>"
        "<services><service><name>t</name></service></services></service></services></bom>",
    )
    held = shared_dir(spark)
    before = set(os.listdir(held))
    rows = {r.pointer: r for r in XD.xml_component_elements(docs).select("pointer", "parent_pointer", "parent_ref", "depth", "role", "c.name").collect()}
    services = XD.xml_service_elements(docs).select("pointer", "depth", "parent_ref", "c.name").orderBy("pointer").collect()
    assert set(os.listdir(held)) == before
    assert len(rows) == 10 + 9 + 1
    deep = rows["/components/0" * 10]
    assert (deep.name, deep.depth, deep.parent_ref, deep.parent_pointer) == ("n-9", 9, "c-8", "/components/0" * 9)
    assert rows["/components/0/components/1"].name == "side" and rows["/metadata/component"].role == "main"
    assert [tuple(r) for r in services] == [("/services/0", 0, None, "s"), ("/services/0/services/0", 1, "s", "t")]


def graph(depth):
    return f"<dependency ref='{depth}'>{graph(depth - 1) if depth else ''}</dependency>"


def test_xml_graph_in_one_pass(spark, folder):
    docs = xml(spark, folder, f"<bom version='1'><dependencies>{graph(3)}<dependency ref='e'/><dependency ref='p'><provides ref='q'/></dependency></dependencies></bom>", "<bom version='1'/>")
    before = set(os.listdir(shared_dir(spark)))
    got = {(r.ref, r.kind, r.target, r.declared_empty) for r in XD.xml_dependencies(docs).collect()}
    assert set(os.listdir(shared_dir(spark))) == before
    assert got == {(str(n), "dependsOn", str(n - 1), False) for n in (1, 2, 3)} | {("e", "dependsOn", None, True), ("p", "provides", "q", False)}


def test_xml_graph_too_deep_ends_with_an_error(spark, folder):
    docs = xml(spark, folder, f"<bom version='1'><dependencies>{graph(XD.MAX_GRAPH_DEPTH)}</dependencies></bom>")
    with pytest.raises(Exception, match="nest deeper than"):
        XD.xml_dependencies(docs).collect()


def test_tasks_grow_with_the_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(derived, "LINES_A_TASK", 10)
    spark.range(100).select(F.col("id").alias("l_orderkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    t = derived.Tables(spark, str(tmp_path))
    assert t.line_by_document.rdd.getNumPartitions() == 10
    assert t.line_by_document.count() == 100
