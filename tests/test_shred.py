"""Objects of documents: references, uses, properties and rules of every kind of object."""

import json
from collections import Counter

from frames import doc_frame

from bomspark.model import doc_schema as D
from bomspark.operators import flatten as X, rules as R, shape_rules as V, shred as H

HEAD = {"specVersion": "1.7", "serialNumber": "urn:uuid:5b1f1e0c-93d4-4d0e-8a52-6a1c0f7e2d90", "version": 1}
PART = {"type": "library", "name": "n", "version": "1"}


def doc(**top):
    return json.dumps({**HEAD, **top})


def parts(**members):
    return doc(components=[{**PART, **members}])


def crypto(**members):
    return parts(type="cryptographic-asset", cryptoProperties=members)


def vulnerability(**members):
    return doc(vulnerabilities=[{"id": "V-1", **members}])


def task(**members):
    return doc(formulation=[{"workflows": [{"bom-ref": "w", "uid": "w", "tasks": [{"bom-ref": "t", "uid": "t", **members}]}]}])


# documents with one wrong value or member each, and the rule that has to name it
WRONG = {
    "asset type": (crypto(assetType="gizmo"), "enum"),
    "primitive": (crypto(assetType="algorithm", algorithmProperties={"primitive": "gizmo"}), "enum"),
    "one of the functions": (crypto(assetType="algorithm", algorithmProperties={"cryptoFunctions": ["sign", "gizmo"]}), "enum"),
    "task type": (task(taskTypes=["build", "gizmo"]), "enum"),
    "model approach": (parts(type="machine-learning-model", modelCard={"modelParameters": {"approach": {"type": "gizmo"}}}), "enum"),
    "acknowledgement": (parts(licenses=[{"license": {"name": "x", "acknowledgement": "gizmo"}}]), "enum"),
    "aggregate without members": (doc(compositions=[{"aggregate": "gizmo"}]), "enum"),
    "aggregate too new": (json.dumps({"specVersion": "1.3", "version": 1, "compositions": [{"aggregate": "incomplete_first_party_opensource_only"}]}), "enum"),
    "response": (vulnerability(analysis={"state": "in_triage", "response": ["gizmo"]}), "enum"),
    "annotation time": (doc(annotations=[{"subjects": ["a"], "annotator": {"individual": {"name": "i"}}, "timestamp": "banana", "text": "t"}]), "timestamp"),
    "vulnerability time": (vulnerability(created="banana"), "timestamp"),
    "task time": (task(timeStart="2024-01-01"), "timestamp"),
    "patent date": (doc(definitions={"patents": [{"patentNumber": "1", "filingDate": "2024-13-01"}]}), "timestamp"),
    "member of a vulnerability": (vulnerability(gizmo=1), "unknown_field"),
    "member of a dependency": (doc(dependencies=[{"ref": "a", "gizmo": "b"}]), "unknown_field"),
    "member of a contact": (parts(supplier={"name": "s", "contact": [{"gizmo": "x"}]}), "unknown_field"),
    "member of a nested part": (parts(components=[{**PART, "components": [{**PART, "gizmo": 1}]}]), "unknown_field"),
    "member of an ancestor": (parts(pedigree={"ancestors": [{**PART, "gizmo": 1}]}), "unknown_field"),
}
RIGHT = {
    "crypto": crypto(assetType="algorithm", oid="1.2", algorithmProperties={"primitive": "ae", "mode": "gcm", "cryptoFunctions": ["encrypt", "decrypt"]}),
    "graph": parts(type="data", data=[{"type": "dataset", "graphics": {"description": "d", "collection": [{"name": "g"}]}}]),
    "older tools": json.dumps({"specVersion": "1.4", "version": 1, "metadata": {"tools": [{"vendor": "v", "name": "n", "version": "1"}]}}),
    "tools": doc(metadata={"tools": {"components": [PART], "services": [{"name": "s"}]}}),
    "signed": parts(signature={"algorithm": "ES256", "anything": {"at": "all"}}),
    "null members": parts(gizmo=None, licenses=None),
    "task": task(taskTypes=["build"], timeStart="2024-01-01T00:00:00Z", inputs=[{"resource": {"ref": "a"}, "environmentVars": [{"name": "a", "value": "b"}, "c"]}]),
}


def test_wrong_values_of_every_kind(spark):
    texts = [t for t, _ in WRONG.values()] + list(RIGHT.values())
    docs = doc_frame(spark, *texts)
    got = {int(r.bom_id): (r.valid, r.first_rule) for r in R.document_verdict(docs, R.validate(docs)).collect()}
    for i, (name, (_, rule)) in enumerate(WRONG.items()):
        assert got[i] == (False, rule), name
    for i, name in enumerate(RIGHT, len(WRONG)):
        assert got[i] == (True, None), name


def test_refs_of_organizations_count(spark):
    twice = parts(**{"bom-ref": "x", "supplier": {"bom-ref": "x", "name": "s"}})
    named = doc(
        components=[{**PART, "supplier": {"bom-ref": "s", "name": "s"}}],
        annotations=[{"subjects": ["s"], "annotator": {"individual": {"name": "i"}}, "timestamp": "2024-01-01T00:00:00Z", "text": "t"}],
    )
    docs = doc_frame(spark, twice, named)
    got = [(r.bom_id, r.rule) for r in R.validate(docs).collect()]
    assert got == [("0", "ref_unique")]


def everything(kind, shapes, depth=0):
    """An object of a kind with each member set once, a ref wherever one may be."""
    out, graph = {}, H.automaton()
    for member, inner in graph[kind].items():
        if inner is None:
            out[member] = f"{kind}-{next(shapes)}" if member == "bom-ref" else "v"
        elif depth < 3 or inner != kind:
            if depth < 12 and shapes_left(kind, member, shapes):
                value = everything(inner, shapes, depth + 1)
                out[member] = value if member in SINGLE else [value]
    return out


SINGLE = {"metadata", "tools", "declarations", "definitions", "license", "organization", "individual", "pedigree", "evidence", "modelCard"}


class Counted:
    """Numbers, and which (kind, member) was entered: each is entered once."""

    def __init__(self):
        self.n, self.seen = 0, set()

    def __next__(self):
        self.n += 1
        return self.n


def shapes_left(kind, member, counted):
    new = (kind, member) not in counted.seen
    counted.seen.add((kind, member))
    return new


def refs_by_hand(v):
    if isinstance(v, dict):
        return ([v["bom-ref"]] if "bom-ref" in v else []) + [r for x in v.values() for r in refs_by_hand(x)]
    return [r for x in v for r in refs_by_hand(x)] if isinstance(v, list) else []


def test_a_ref_in_every_kind_of_object(spark):
    top = everything("document", Counted()) | {"specVersion": "1.7"}
    docs = doc_frame(spark, json.dumps(top))
    got = X.bom_ref_index(docs).collect()
    assert sorted(r.ref for r in got) == sorted(refs_by_hand(top))
    with_ref = {k for k, m in H.automaton().items() if "bom-ref" in m}
    assert {r.ref.rsplit("-", 1)[0] for r in got} == with_ref and len(with_ref) > 25
    assert {r.member for r in V.check_members(H.objects(docs, V.wanted())).selectExpr("value AS member").collect()} == set()


def test_properties_of_every_owner(spark):
    p = [{"name": "a", "value": "1"}, {"name": "a"}]
    top = {
        "properties": p, "metadata": {"properties": p, "licenses": [{"license": {"id": "MIT", "properties": p}}]},
        "components": [{**PART, "bom-ref": "c", "properties": p, "modelCard": {"properties": p}, "externalReferences": [{"type": "vcs", "url": "u", "properties": p}]}],
        "formulation": [{"properties": p, "workflows": [{"bom-ref": "w", "properties": p, "tasks": [{"properties": p}]}]}],
        "definitions": {"standards": [{"requirements": [{"bom-ref": "r", "properties": p}]}]},
    }
    got = X.explode_properties(doc_frame(spark, json.dumps(top))).collect()
    owners = Counter((r.owner_pointer, r.owner_ref) for r in got)
    assert owners == dict.fromkeys([
        ("", None), ("/metadata", None), ("/metadata/licenses/0/license", None), ("/components/0", "c"), ("/components/0/modelCard", None),
        ("/components/0/externalReferences/0", None), ("/formulation/0", None), ("/formulation/0/workflows/0", "w"),
        ("/formulation/0/workflows/0/tasks/0", None), ("/definitions/standards/0/requirements/0", "r"),
    ], 2)
    assert {(r.position, r.name, r.value) for r in got} == {(0, "a", "1"), (1, "a", None)}


def test_uses_of_every_kind(spark):
    top = {
        "dependencies": [{"ref": "a", "dependsOn": ["b", "c"], "provides": ["d"]}], "compositions": [{"aggregate": "complete", "assemblies": ["e"], "vulnerabilities": ["f"]}],
        "components": [{**PART, "cryptoProperties": {"protocolProperties": {"ikev2TransformTypes": {"encr": [{"name": "x", "algorithm": "g"}], "prf": ["h"]}}}}],
        "formulation": [{"workflows": [{"taskDependencies": [{"ref": "t", "dependsOn": ["u"]}], "resourceReferences": [{"ref": "i"}]}]}],
    }
    got = Counter((r.field, r.target) for r in X.ref_use_index(doc_frame(spark, json.dumps(top))).collect())
    assert got == Counter([
        ("dependency.ref", "a"), ("dependency.dependsOn", "b"), ("dependency.dependsOn", "c"), ("dependency.provides", "d"), ("composition", "e"),
        ("composition", "f"), ("crypto", "g"), ("crypto", "h"), ("task.ref", "t"), ("task.dependsOn", "u"), ("resource.ref", "i"),
    ])


def test_uses_and_rules_name_members_of_the_shapes(spark):
    graph = H.automaton()
    tables = [H.USES, V.ENUM_MEMBERS, {k: v.split() for k, v in (V.TIME_MEMBERS | V.DATE_MEMBERS).items()}, {k: [m for p in v for m in p] for k, v in V.ORDERED.items()}]
    assert [(k, m) for t in tables for k, ms in t.items() for m in ms if m not in graph[k]] == []
    assert set(D.MORE_MEMBERS) <= set(graph)


def test_times_that_run_backwards(spark):
    docs = doc_frame(spark, vulnerability(created="2024-02-01T00:00:00Z", published="2024-01-01T00:00:00Z"), task(timeStart="2024-02-01T00:00:00Z", timeEnd="2024-03-01T00:00:00Z"))
    got = [(r.bom_id, r.rule, r.pointer) for r in V.check_order(H.objects(docs, V.wanted())).collect()]
    assert got == [("0", "date_order", "/vulnerabilities/0")]


def test_odd_documents_give_no_rows_and_deep_ones_all(spark):
    deep = {**PART, "bom-ref": "0"}
    for i in range(1, 300):
        deep = {**PART, "bom-ref": str(i), "components": [deep]}
    texts = [None, "", "[]", "3", "{broken", "{}", json.dumps({"components": [deep]}), json.dumps({"components": [None, 3, "x", []], "properties": {}})]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(6, texts[6], "again")]
    docs = spark.createDataFrame(rows, "bom_id long, content string, pointer string")
    got = Counter(r.bom_id for r in X.bom_ref_index(docs).collect())
    assert got == {6: 600}
    assert X.bom_ref_index(docs.limit(0)).count() == 0


def test_batches_keep_every_row(spark):
    many = json.dumps({"components": [{**PART, "bom-ref": str(i)} for i in range(45_000)]})
    docs = doc_frame(spark, many, many)
    assert X.bom_ref_index(docs).select("bom_id", "ref").distinct().count() == 90_000
