"""Documents -> one row per object, in one pass over the text.

The document shapes (:mod:`bomspark.model.doc_schema`) are compiled to a path
automaton: element kind x member -> is it a value, a list, objects of which
kind. A walk along it turns each document into rows

``bom_id, spec_version, pointer, element, owner_pointer, owner_ref, position,
names, fields, lists``

``fields`` holds the members that are one value, ``lists`` those that are lists
of values, both as text and only as far as the caller wants them; ``names`` all
members the object really has. References, their uses, properties and the rules
over values are filters and joins on this frame. Nothing is shuffled, and a
document is read once however deep it nests. A kind or member that is added to
the shapes needs no code here.

Texts that are null, empty or not one JSON object give no row. Members that are
null count as absent. Repeated documents give repeated rows. The walk keeps one
document at a time and hands its rows on in batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..model import doc_schema as D

#: Rows handed on at once.
_BATCH = 20_000

# Kinds of objects by the member that holds them.
_KIND = {
    "components": "component", "ancestors": "component", "descendants": "component", "variants": "component", "services": "service",
    "vulnerabilities": "vulnerability", "compositions": "composition", "annotations": "annotation", "citations": "citation",
    "formulation": "formula", "workflows": "workflow", "tasks": "task", "assessors": "assessor", "claims": "claim",
    "standards": "standard", "requirements": "requirement", "levels": "level", "patents": "patent", "properties": "property",
    "dependencies": "dependency", "taskDependencies": "taskDependency", "runtimeTopology": "topologyDependency", "tool": "tool",
    "licenses": "licenseChoice", "externalReferences": "externalReference", "hashes": "hash", "attestations": "attestation",
    "map": "attestationMap", "ratings": "rating", "lifecycles": "lifecycle", "triggers": "trigger", "workspaces": "workspace",
    "occurrences": "occurrence", "datasets": "data", "patentAssertions": "patentAssertion", "energyProviders": "energyProvider",
    "energyConsumptions": "energyConsumption", "signatories": "signatory",
    "environmentVars": "environmentVar",
}
# Members whose objects are of a kind of their own though their shape is shared.
_OWN_KIND = ("taskDependencies", "runtimeTopology", "environmentVars")


def _shapes_by_kind() -> dict[str, str]:
    one = lambda ddl: ddl.removeprefix("array<")[:-1]
    named = {
        "organization": D.ORGANIZATION, "contact": D.CONTACT, "address": D.ADDRESS, "attachment": D.ATTACHMENT, "party": D.PARTY,
        "component": D.COMPONENT, "service": D.SERVICE, "dataFlow": one(D.DATA_FLOWS), "data": D.COMPONENT_DATA,
        "componentEvidence": D.EVIDENCE, "identity": D.EVIDENCE_IDENTITY, "governance": D.GOVERNANCE, "governanceParty": D.GOVERNANCE_PARTY,
        "issue": D.ISSUE, "resourceReference": D.RESOURCE, "relatedAsset": one(D.RELATED_ASSETS), "measure": D.MEASURE,
        "property": one(D.PROPERTIES), "hash": one(D.HASHES), "externalReference": one(D.EXTERNAL_REFERENCES), "licenseChoice": one(D.LICENSES),
        "input": one(D.INPUTS), "output": one(D.OUTPUTS),
    }
    return {T.DataType.fromDDL(ddl).simpleString(): kind for kind, ddl in named.items()}


def _open(member: str, known: T.DataType, shapes: dict[str, T.DataType]) -> T.DataType:
    """Type of a member; open members get the shape of their name."""
    if member in D.OPEN_MEMBERS:
        return shapes[member]
    element = known.elementType if isinstance(known, T.ArrayType) else known
    return shapes.get(member, known) if isinstance(element, T.VariantType) else known


@cache
def automaton() -> dict[str, dict[str, str | None]]:
    """kind -> member -> kind of its objects, or None where it holds values.
    Made once on the driver; plain data of fixed size."""
    from ..sources.xml_json import document_shapes

    shapes = document_shapes()
    shapes |= {name: T.DataType.fromDDL(ddl) for name, ddl in D.OPEN_MEMBERS.items()}
    more = {kind: T.DataType.fromDDL(f"struct<{ddl}>").fields for kind, ddl in D.MORE_MEMBERS.items()}
    by_shape = _shapes_by_kind()
    graph: dict[str, dict[str, str | None]] = {}
    made = {kind: text for text, kind in by_shape.items()}
    todo = [("document", shapes[""])]
    while todo:
        kind, shape = todo.pop()
        if kind in graph:
            continue
        members = graph[kind] = {}
        for f in [*shape.fields, *more.get(kind, [])]:
            t = _open(f.name, f.dataType, shapes)
            t = t.elementType if isinstance(t, T.ArrayType) else t
            if not isinstance(t, T.StructType):
                members[f.name] = None
                continue
            text = t.simpleString()
            name = _KIND[f.name] if f.name in _OWN_KIND else by_shape.get(text, _KIND.get(f.name, f.name))
            if made.setdefault(name, text) != text:
                name = f"{kind}.{f.name}"
                made[name] = text
            members[f.name] = name
            todo.append((name, t))
    graph["tool"] = dict.fromkeys(f.name for f in shapes["tool"].fields) | {"hashes": "hash", "externalReferences": "externalReference"}
    return graph


def known_members(kind: str) -> list[str]:
    """Members of a kind; any object may be signed."""
    return [*automaton()[kind], "signature"]


def _text(v) -> str:
    return v if isinstance(v, str) else json.dumps(v)


def _kind_of(kind: str | None, v) -> str | None:
    """Kind of a member's objects; a list of tools is the older form."""
    return "tool" if kind == "tools" and isinstance(v, list) else kind


def document_objects(text: str | None, graph: dict, wanted: dict[str, frozenset] | None) -> Iterator[tuple]:
    """Rows of one document in document order. ``wanted``: kinds and the
    members to keep of each; other kinds are passed through."""
    try:
        top = json.loads(text or "")
    except ValueError:
        return
    if not isinstance(top, dict):
        return
    version = top.get("specVersion")
    version = version if isinstance(version, str) else None
    todo = [("", "document", None, None, None, top)]
    while todo:
        pointer, kind, owner, owner_ref, position, o = todo.pop()
        members, keep = graph[kind], None if wanted is None else wanted.get(kind)
        fields, lists, below = [], [], []
        ref = o.get("bom-ref")
        ref = ref if isinstance(ref, str) else None
        for name, v in o.items():
            if v is None or name not in members:
                continue
            inner = _kind_of(members[name], v)
            if isinstance(v, dict):
                if inner:
                    below.append((f"{pointer}/{name}", inner, pointer, ref, None, v))
            elif isinstance(v, list):
                if inner:
                    below += [(f"{pointer}/{name}/{i}", inner, pointer, ref, i, x) for i, x in enumerate(v) if isinstance(x, dict)]
                if keep is None or name in keep:
                    values = [_text(x) for x in v if x is not None and not isinstance(x, (dict, list))]
                    if values:
                        lists.append((name, values))
            elif keep is None or name in keep:
                fields.append((name, _text(v)))
        if wanted is None or keep is not None:
            yield version, pointer, kind, owner, owner_ref, position, [n for n, v in o.items() if v is not None], fields, lists
        todo.extend(reversed(below))


_COLUMNS = (
    "spec_version string, pointer string, element string, owner_pointer string, owner_ref string, position int, "
    "names array<string>, fields map<string, string>, lists map<string, array<string>>"
)
_ARROW = [
    pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()),
    pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.list_(pa.string())),
]


def objects(docs: DataFrame, wanted: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Objects of documents ``(bom_id, content)``; ``wanted`` limits kinds and members."""
    graph = automaton()
    keep = None if wanted is None else {k: frozenset(v) for k, v in wanted.items()}
    id_field = docs.schema["bom_id"]
    schema = T.StructType([T.StructField("bom_id", id_field.dataType), *T.DataType.fromDDL(f"struct<{_COLUMNS}>").fields])
    names = schema.names

    def batch(ids, at, rows) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *columns], names=names)

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            at, rows = [], []
            for i in range(b.num_rows):
                for row in document_objects(texts[i].as_py(), graph, keep):
                    at.append(i)
                    rows.append(row)
                    if len(rows) == _BATCH:
                        yield batch(ids, at, rows)
                        at, rows = [], []
            if rows:
                yield batch(ids, at, rows)

    return docs.select("bom_id", "content").mapInArrow(run, schema)


# ------------------------------------------------------------------ refs, uses, properties

# Members that hold references, and the name of the use.
USES = {
    "dependency": {"ref": "dependency.ref", "dependsOn": "dependency.dependsOn", "provides": "dependency.provides"},
    "taskDependency": {"ref": "task.ref", "dependsOn": "task.dependsOn"},
    "topologyDependency": {"ref": "topology.ref", "dependsOn": "topology.dependsOn"},
    "composition": dict.fromkeys(("assemblies", "dependencies", "vulnerabilities"), "composition"),
    "affects": {"ref": "affects.ref"}, "annotation": {"subjects": "annotation.subject"},
    "attestation": {"assessor": "attestation.assessor"},
    "attestationMap": {"requirement": "attestation.requirement", "claims": "attestation.claim", "counterClaims": "attestation.claim"},
    "claim": {"target": "claim.target", "evidence": "claim.evidence", "counterEvidence": "claim.evidence"},
    "requirement": {"parent": "requirement.parent"}, "level": {"requirements": "level.requirement"},
    "citation": {"attributedTo": "citation.attributedTo", "process": "citation.process"},
    "patent": {"members": "family.member"}, "patentAssertion": {"patentRefs": "assertion.patent"}, "asserter": {"ref": "assertion.asserter"},
    "identity": {"tools": "identity.tool"}, "data": {"ref": "dataset.ref"}, "resourceReference": {"ref": "resource.ref"},
    "certificateProperties": dict.fromkeys(("signatureAlgorithmRef", "subjectPublicKeyRef"), "crypto"),
    "relatedCryptoMaterialProperties": {"algorithmRef": "crypto"}, "securedBy": {"algorithmRef": "crypto"},
    "cipherSuites": {"algorithms": "crypto"}, "protocolProperties": {"cryptoRefArray": "crypto"}, "relatedAsset": {"ref": "crypto"},
    "ikev2TransformTypes": dict.fromkeys(("encr", "prf", "integ", "ke", "auth"), "crypto"),
    **dict.fromkeys(("encr", "prf", "integ", "ke", "auth"), {"algorithm": "crypto"}),
}


def wanted_refs() -> dict[str, tuple[str, ...]]:
    return {kind: ("bom-ref",) for kind, members in automaton().items() if "bom-ref" in members}


def wanted_uses() -> dict[str, tuple[str, ...]]:
    return {kind: tuple(members) for kind, members in USES.items() if kind in automaton()}


WANTED_PROPERTIES = {"property": ("name", "value")}


def merged(*parts: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for part in parts:
        for kind, members in part.items():
            out[kind] = tuple(dict.fromkeys([*out.get(kind, ()), *members]))
    return out


def refs_of(objs: DataFrame) -> DataFrame:
    """Every declared ref. A license's pointer is that of its entry in the list."""
    ref = F.col("fields")["bom-ref"]
    kind = F.when(F.col("element") == "licenseChoice", "license").otherwise(F.col("element"))
    place = F.when(F.col("element") == "license", F.col("owner_pointer")).otherwise(F.col("pointer"))
    return objs.filter(ref.isNotNull()).select("bom_id", ref.alias("ref"), kind.alias("element_type"), place.alias("pointer"))


def values_of(objs: DataFrame) -> DataFrame:
    """(member, value) of every value of every object, list items one by one."""
    one = F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("member"), e["value"].alias("value")))
    many = F.flatten(F.transform(
        F.map_entries("lists"), lambda e: F.transform(e["value"], lambda x: F.struct(e["key"].alias("member"), x.alias("value")))
    ))
    return objs.select("bom_id", "spec_version", "pointer", "element", F.inline(F.concat(one, many)))


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def uses_of(objs: DataFrame) -> DataFrame:
    label = _literal_map({f"{kind}.{m}": use for kind, members in USES.items() for m, use in members.items()})
    rows = values_of(objs.filter(F.col("element").isin(*USES)))
    field = F.try_element_at(label, F.concat_ws(".", "element", "member"))
    return rows.select("bom_id", field.alias("field"), F.col("value").alias("target"), "pointer").filter("field IS NOT NULL")


def properties_of(objs: DataFrame) -> DataFrame:
    f = F.col("fields")
    return objs.filter("element = 'property'").select(
        "bom_id", "owner_pointer", "owner_ref", F.coalesce("position", F.lit(0)).alias("position"), f["name"].alias("name"), f["value"].alias("value")
    )
