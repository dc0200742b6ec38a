"""XML documents as the document frame that JSON documents give.

The document shapes (:mod:`bomspark.model.doc_schema`) drive one walk over the
elements: a member's type says whether its element is a value, a struct or a
list, so every section that a JSON operator reads comes out of XML as well, and
all element tables and rules apply to both. Elements the shapes don't know stay
under their own names, so that rules can report them. A document is one row, as
in JSON; nested ``dependency`` elements are read to any depth.
"""

from __future__ import annotations

import json
import sys
import xml.etree.ElementTree as ET
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..model import doc_schema as D
from .documents import XML_GLOB, typed

# Members of the JSON form whose elements have another name.
_RENAMED = {"responses": "response", "content-type": "contentType", "cryptoRef": "cryptoRefArray"}
# Lists whose items are named like a member of the item.
_WRAPPERS = {"versions", "copyright"}
# The member that holds the text of an element with attributes.
_TEXT = ("content", "value", "expression", "text", "classification")
#: Python frames that nested components may take.
_FRAMES = 20_000


def document_shapes() -> dict[str, T.DataType]:
    """Shape of a document (under the empty name) and of the members that it
    leaves open, by name. Made on the driver; plain data, so tasks can have it."""
    kind = T.DataType.fromDDL
    component, service = kind(D.COMPONENT), kind(D.SERVICE)
    one = {"": kind(f"struct<{D.DOCUMENT}>"), "component": component, "service": service, "evidence": kind(D.EVIDENCE), "pedigree": kind(D.PEDIGREE)}
    one |= {"releaseNotes": kind(D.RELEASE_NOTES), "modelCard": kind(D.MODEL_CARD), "cryptoProperties": kind(D.CRYPTO), "governance": kind(D.GOVERNANCE)}
    one["tools"] = T.StructType([T.StructField("components", T.ArrayType(component)), T.StructField("services", T.ArrayType(service))])
    one["tool"] = kind(f"struct<vendor string, name string, version string, hashes {D.HASHES}, externalReferences {D.EXTERNAL_REFERENCES}>")
    lists = {"components": component, "services": service, "ancestors": component, "descendants": component, "variants": component}
    lists |= {"identity": kind(D.EVIDENCE_IDENTITY), "data": kind(D.COMPONENT_DATA), "datasets": kind(D.COMPONENT_DATA)}
    return one | {k: T.ArrayType(v) for k, v in lists.items()}


@lru_cache(10_000)
def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _scalar(text: str | None, kind: T.DataType | None):
    text = (text or "").strip() if not isinstance(kind, T.StringType) else (text or "")
    try:
        if isinstance(kind, T.BooleanType):
            return {"true": True, "1": True, "false": False, "0": False}.get(text, text)
        if isinstance(kind, T.IntegralType):
            return int(text)
        if isinstance(kind, T.FractionalType):
            return float(text)
    except ValueError:
        pass
    return text


def _graph(root: ET.Element) -> list[dict]:
    """Rows of a graph whose elements may nest; each nested one is a target of the one around it."""
    rows, seen, todo = [], {}, [(e, True) for e in reversed(root)]
    while todo:
        e, top = todo.pop()
        deps = [k for k in e if _local(k.tag) == "dependency"]
        provides = [k.get("ref") for k in e if _local(k.tag) == "provides"]
        if top or deps or provides:
            row = seen.setdefault(e.get("ref"), {"ref": e.get("ref")})
            if not any(row is r for r in rows[-1:]) and len(row) == 1:
                rows.append(row)
            if deps or not provides:
                row["dependsOn"] = list(dict.fromkeys([*row.get("dependsOn", []), *[k.get("ref") for k in deps]]))
            if provides:
                row["provides"] = list(dict.fromkeys([*row.get("provides", []), *provides]))
        todo.extend((k, False) for k in reversed(deps))
    return rows


class Walk:
    """Values of elements by the document shapes."""

    def __init__(self, shapes: dict[str, T.DataType]):
        self.shapes = shapes
        self.known: dict[int, tuple] = {}

    def fields(self, kind: T.DataType | None) -> dict[str, T.DataType]:
        """Members of a struct with their types; made once for each shape."""
        held = self.known.get(id(kind))
        if held is None:
            made = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
            held = self.known[id(kind)] = (made, kind)  # held, so that its id stays its own
        return held[0]

    def shape(self, name: str, known: T.DataType | None) -> T.DataType | None:
        """Type of a member: its own, or that of the open member of its name."""
        if isinstance(known, T.ArrayType) and isinstance(known.elementType, T.VariantType) or isinstance(known, T.VariantType):
            return self.shapes.get(name)
        return known

    def flows(self, e: ET.Element) -> list[dict]:
        out = []
        for k in e:
            if _local(k.tag) == "classification":
                out.append({"flow": k.get("flow"), "classification": (k.text or "").strip()})
                continue
            one = {"name": k.get("name"), "description": k.get("description")}
            for m in k:
                name = _local(m.tag)
                if name == "classification":
                    one |= {"flow": m.get("flow"), "classification": (m.text or "").strip()}
                elif name in ("source", "destination"):
                    one[name] = [u.text for u in m]
                else:
                    one[name] = self.value(m, name, self.shapes["governance"] if name == "governance" else None)
            out.append({n: v for n, v in one.items() if v is not None})
        return out

    def licenses(self, e: ET.Element, item: T.StructType) -> list[dict]:
        out = []
        for k in e:
            value = self.value(k, _local(k.tag), item["license"].dataType if _local(k.tag) == "license" else item)
            out.append({"license": value} if _local(k.tag) == "license" else value)
        return out

    @staticmethod
    def names_any(e: ET.Element, fields) -> bool:
        return any(_local(k.tag) in fields for k in e) or any(_local(k) in fields for k in e.attrib)

    def items(self, elements: list[ET.Element], name: str, item: T.DataType) -> list:
        fields = self.fields(item).keys()
        graph, flows = {"ref", "dependsOn"} <= fields, {"flow", "destination"} <= fields
        out = []
        for e in elements:
            if graph:
                out += _graph(e)
            elif name == "licenses":
                out += self.licenses(e, item)
            elif flows:
                out += self.flows(e)
            elif name not in _WRAPPERS and (self.names_any(e, fields) if fields else not len(e) and (e.text or e.attrib)):
                out.append(self.value(e, name, item))
            else:
                out += [self.value(k, _local(k.tag), item) for k in e]
        return out

    def value(self, e: ET.Element, name: str, kind: T.DataType | None):
        """JSON value of an element of this shape (null: unknown)."""
        kind = self.shape(name, kind) or kind
        if isinstance(kind, T.ArrayType):
            return self.items([e], name, kind.elementType)
        if isinstance(kind, T.AtomicType) and not isinstance(kind, T.VariantType):
            return _scalar(e.text if (e.text or "").strip() or not e.get("ref") else e.get("ref"), kind)
        fields = self.fields(kind)
        if not len(e) and not e.attrib and not fields:
            return e.text or ""
        out = {}
        for key, v in e.attrib.items():
            key = _RENAMED.get(_local(key), _local(key))
            out[key] = _scalar(v, fields.get(key))
        if not len(e) and (e.text or "").strip():
            member = next((m for m in _TEXT if m in fields and m not in out), "value")
            out[member] = e.text
        groups: dict[str, list[ET.Element]] = {}
        for k in e:
            groups.setdefault(_local(k.tag), []).append(k)
        for tag, own in groups.items():
            key = _RENAMED.get(tag, tag)
            inner = self.shape(key, fields.get(key)) if key in fields else None
            if key == "tools" and isinstance(fields.get(key), T.VariantType) and any(_local(t.tag) == "tool" for k in own for t in k):
                out[key] = [self.value(t, "tool", self.shapes["tool"]) for k in own for t in k]
            elif isinstance(inner, T.ArrayType):
                out[key] = self.items(own, key, inner.elementType)
            else:
                got = [self.value(k, key, inner) for k in own]
                out[key] = got[0] if len(got) == 1 else got
        return out


def document_json(text: str, shapes: dict[str, T.DataType] | Walk, bom_format: str | None = None) -> str:
    """JSON text of an XML document. Raises ``ParseError`` for broken text."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), _FRAMES))
    root = ET.fromstring(text)
    doc = {"bomFormat": bom_format} if bom_format else {}
    space = root.tag[1:].split("}")[0] if root.tag.startswith("{") else ""
    if "/schema/bom/" in space:
        doc["specVersion"] = space.rsplit("/", 1)[-1]
    walk = shapes if isinstance(shapes, Walk) else Walk(shapes)
    body = walk.value(root, "", walk.shapes[""])
    doc |= body if isinstance(body, dict) else {}
    doc["version"] = _scalar(str(doc.get("version", 1)), T.IntegerType())
    return json.dumps(doc, ensure_ascii=False)


def json_content(content: Column, bom_format: str | None = None) -> Column:
    """JSON text of XML documents; broken ones stay as they are and are no
    JSON, so :func:`documents.quarantine_corrupt` finds them."""

    shapes = document_shapes()

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        walk = Walk(shapes)

        def one(text):
            try:
                return None if text is None else document_json(text, walk, bom_format)
            except ET.ParseError:
                return text

        return texts.map(one)

    return convert(content)


def xml_documents(raw: DataFrame, bom_format: str | None = None) -> DataFrame:
    """Document frame of ``raw(source_path, content)`` with XML texts."""
    bom_id = F.sha2(F.concat_ws("\u0000", "source_path", "content"), 256)
    docs = raw.select(bom_id.alias("bom_id"), "source_path", F.lit("xml").alias("format"), json_content(F.col("content"), bom_format).alias("content"))
    return typed(docs)


def read_bom_xml_documents(spark: SparkSession, path: str, glob: str | None = XML_GLOB, bom_format: str | None = None) -> DataFrame:
    """One row per file, as :func:`documents.read_bom_json` gives it: all
    operators and rules that take JSON documents take these."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("content"))
    docs = xml_documents(raw, bom_format)
    return docs.withColumn("variant", F.try_parse_json("content"))
