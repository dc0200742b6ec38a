"""Queries that read their documents several times read them once, and cast only what they take."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from bomspark.operators import flatten as X, rules as R
from bomspark.plans.registry import QUERIES
from bomspark.sources import xml_json
from bomspark.sources.documents import typed


def docs_of(spark, *docs):
    return typed(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "bom_id long, content string"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def tables(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    lines = [(o, p, p, n, 5.0, 0.1, 0.02, "A", "O", day) for o in (1, 2) for n, p in enumerate((1, 2, 1, 2, 1, 2), 1)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "p 1", "B#1", "PROMO", 3), (2, "p 2", "B#2", "SMALL", 4)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    orders = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame([(1, 7, "O", day, "5-LOW"), (2, 7, "F", day, "4-X")], orders).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["filter_by_property", "assembly_tree", "explode_parties", "read_bom_xml_documents"])
def test_kept_frames_are_read_instead_of_documents(spark, tables, name):
    got = QUERIES[name](spark, tables)
    assert "lineitem.parquet" not in plan(got)
    rows = [tuple(r) for r in got.collect()]
    want = {
        "filter_by_property": {(o, f"c-{n}", "p-2") for o in (1, 2) for n in (2, 4, 6)},
        "assembly_tree": {(1, "c-1", "c-1", 1), (2, "c-5", "b-1>c-5", 2), (1, "c-6", "b-1>b-2>c-6", 3), (2, "b-2", "b-1>b-2", 2)},
        "explode_parties": {(1, "supplier", "organization", "S-1", "C-1"), (2, "supplier", "organization", "M-2", None)},
        "read_bom_xml_documents": {("dependency", "c-1", "c-2", 2), ("assembly", "c-6", "complete", 2), ("license", "c-1", "MIT", 2)},
    }[name]
    assert want <= set(rows)
    assert len(rows) == {"filter_by_property": 6, "assembly_tree": 16, "explode_parties": 14, "read_bom_xml_documents": 24}[name]


def test_evidence_tools_keep_identities(spark, tables):
    got = QUERIES["evidence_tools"](spark, tables)
    # one reading for the names of the tools; identities are kept
    assert plan(got).count("lineitem.parquet") <= 2
    assert sorted(map(tuple, got.collect())) == sorted((o, f"x-{n}", f"tool-{2 - n % 2}", "One" if n % 2 else None) for o in (1, 2) for n in range(1, 7))


def test_taken_members_alone_are_cast(spark):
    docs = docs_of(spark, {"components": [{"name": "n", "bom-ref": "r", "scope": {"no": "text"}, "hashes": [{"alg": "MD5", "content": "x"}]}, 7]})
    whole, some = (X.component_elements(docs, ("inventory",), taken=t) for t in (None, ("bom-ref", "name", "scope")))
    assert some.schema["c"].dataType.names == ["bom-ref", "name", "scope"]
    pick = lambda el: [tuple(r) for r in el.select("pointer", F.col("c")["bom-ref"], "c.name", "c.scope").orderBy("pointer").collect()]
    assert pick(whole) == pick(some) and len(pick(some)) == 2


def test_transforms_of_all_kinds_in_one_pass(spark):
    kinds = {"encr": [{"name": "AES", "keyLength": 256, "algorithm": "a"}], "ke": [{"group": 3, "algorithm": "k"}, "plain"], "auth": []}
    crypto = {"assetType": "protocol", "protocolProperties": {"ikev2TransformTypes": kinds}}
    docs = docs_of(spark, {"components": [{"bom-ref": "t", "cryptoProperties": crypto}, {"bom-ref": "u"}, {"bom-ref": "v", "cryptoProperties": {"assetType": "algorithm"}}]})
    got = X.explode_crypto(X.component_elements(docs, ("inventory",)))["crypto_transform"]
    assert "Union" not in plan(got)
    rows = {(r.ref, r.transform, r.position, r.name, r.key_length, r.algorithm) for r in got.collect()}
    assert rows == {("t", "encr", 0, "AES", 256, "a"), ("t", "ke", 0, "3", None, "k"), ("t", "ke", 1, None, None, "plain")}


def test_doubtful_members_alone_meet_versions(spark):
    docs = docs_of(
        spark, {"specVersion": "1.5", "odd": 1, "citations": [], "metadata": {"strange": 1, "manufacturer": {}}, "components": [{"bom-ref": "a", "name": "n", "wrong": 1, "tags": [], "evidence": {}}, 7]},
        {"specVersion": "1.7", "components": [{"bom-ref": "b", "name": "n", "tags": []}]}, {"components": [{"name": "n", "tags": [], "bad": 1}]},
    )
    got = R.unknown_fields(docs, X.component_elements(docs, ("inventory",), with_members=True))
    assert {(r.bom_id, r.pointer, r.value) for r in got.collect()} == {
        (0, "", "document.odd"), (0, "", "document.citations"), (0, "/metadata", "metadata.strange"), (0, "/metadata", "metadata.manufacturer"),
        (0, "/components/0", "component.wrong"), (0, "/components/0", "component.tags"), (2, "/components/0", "component.bad"),
    }
    assert plan(got).count("parse_json") <= 1


def test_shapes_are_walked_by_one_compiled_walk(spark):
    shapes = xml_json.document_shapes()
    walk = xml_json.Walk(shapes)
    text = "<bom xmlns='http://e/schema/bom/1.6' version='2'><components><component type='file' bom-ref='a'><name>n</name><tags><tag>t</tag></tags></component></components></bom>"
    first, again = xml_json.document_json(text, shapes), xml_json.document_json(text, walk)
    held = len(walk.known)
    assert first == again == xml_json.document_json(text, walk) and held == len(walk.known) > 0
