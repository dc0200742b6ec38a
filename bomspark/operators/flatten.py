"""Documents -> tables.

Components and services nest without bound: the levels below a start element
are unfolded inside its row, as far as its text can nest, and become rows in one
pass. Everything else is a projection with ``explode`` over the typed view of a
document or of an element. Element frames are not kept: what reads one several
times reads the documents as often, or cuts it first.

Element frames have ``bom_id, pointer, parent_pointer, parent_ref, depth, role,
c`` where ``c`` is the typed component (or service). Child tables carry
``owner_pointer`` and ``owner_ref``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from ..model import doc_schema as D
from ..session import cut, is_empty, kept
from . import shred


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def ts(c: Column) -> Column:
    return F.try_to_timestamp(c)


def parsed(c: Column, shape: str) -> Column:
    return F.try_variant_get(c, "$", shape)


def _fields(shape: str) -> list[tuple[str, str]]:
    """Names and types of the members of a struct in DDL."""
    parts, depth = [""], 0
    for ch in shape.strip()[len("struct<") : -1]:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append("")
        else:
            parts[-1] += ch
    return [(n.strip("`"), kind) for n, kind in (p.strip().split(" ", 1) for p in parts)]


def at(base: Column | str, *steps) -> Column:
    """Pointer text from a base and steps (texts or position columns)."""
    parts = [F.lit(base) if isinstance(base, str) else base]
    for s in steps:
        parts += [F.lit("/"), F.lit(s) if isinstance(s, str) else s.cast("string")]
    return F.concat(*parts)


_ITEM = "array<struct<pointer string, role string, v variant>>"


def _items(values: Column, role: str, prefix: Column | str) -> Column:
    """Start items of one array<variant> of the document."""
    return F.transform(
        values, lambda v, i: F.struct(at(prefix, i).alias("pointer"), F.lit(role).alias("role"), v.alias("v"))
    )


def _item(value: Column, role: str, pointer: Column | str) -> Column:
    p = F.lit(pointer) if isinstance(pointer, str) else pointer
    return F.when(value.isNotNull(), F.array(F.struct(p.alias("pointer"), F.lit(role).alias("role"), value.alias("v"))))


def _each(outer: Column, body) -> Column:
    """Items of every entry of an outer array, flat."""
    return F.flatten(F.transform(outer, lambda x, o: F.coalesce(body(x, o), F.array().cast(_ITEM))))


def _spread(frame: DataFrame, keys: list, items: Column | str, position: str, item: str) -> DataFrame:
    """One row per entry with its position. An inner generator would also be
    turned into a filter on the size of its input, which reads the text twice."""
    held = frame.select(*keys, (F.col(items) if isinstance(items, str) else items).alias("_items"))
    return held.select(*held.columns[:-1], F.posexplode_outer("_items").alias(position, item)).filter(F.col(position).isNotNull())


def _inline(frame: DataFrame, keys: list, items: Column | str) -> DataFrame:
    """One row per struct of an array, its members as columns."""
    rows = _spread(frame, keys, items, "_n", "_x")
    return rows.select(*[c for c in rows.columns if c not in ("_n", "_x")], "_x.*")


def _starts(docs: DataFrame, parts: list[Column]) -> DataFrame:
    """First level of all roles in one pass over the documents."""
    every = F.concat(*[F.coalesce(p, F.array().cast(_ITEM)) for p in parts])
    none = F.lit(None).cast("string")
    return _inline(docs, ["bom_id"], every).select(
        "bom_id", "pointer", none.alias("parent_pointer"), none.alias("parent_ref"), "role", "v"
    )


def _tagged(tag: str, name: str, items: Column, value: str, fn=lambda x: x) -> Column:
    """Array of (tag, value) from an array; null reads as empty."""
    return F.transform(items, lambda x: F.struct(F.lit(tag).alias(name), fn(x).alias(value)))


#: Levels unfolded before the text of an element is searched for how deep it can nest.
_FEW_LEVELS = 6


def _levels(first: DataFrame, shape: str, children: list[tuple[str, str, str | None]], with_members: bool) -> DataFrame:
    """Elements of all levels. ``children`` lists (path of an array in the
    element, pointer step, role or None for the parent's role). The levels below
    a start element are unfolded inside its row, so nothing is written between
    them; no element nests deeper than its text has members that hold children."""

    def kids(e: Column) -> Column:
        ref = F.try_variant_get(e["v"], "$['bom-ref']", "string")
        return F.concat(*[
            F.transform(
                F.coalesce(F.try_variant_get(e["v"], path, "array<variant>"), F.array().cast("array<variant>")),
                lambda v, i: F.struct(  # noqa: B023
                    at(e["pointer"], step, i).alias("pointer"), e["pointer"].alias("parent_pointer"), ref.alias("parent_ref"),  # noqa: B023
                    (e["depth"] + 1).alias("depth"), (F.lit(role) if role else e["role"]).alias("role"), v.alias("v"),  # noqa: B023
                ),
            )
            for path, step, role in children
        ])

    names = "|".join(dict.fromkeys(path.rsplit(".", 1)[-1] for path, _, _ in children))
    deepest = F.regexp_count(F.to_json("e.v"), F.lit(f'"({names})":'))

    def step(found: Column, _: Column) -> Column:
        last = F.element_at(found, -1)
        return F.when(F.size(last) == 0, found).otherwise(F.concat(found, F.array(F.flatten(F.transform(last, kids)))))

    def rest(found: Column) -> Column:
        return F.when(F.size(F.element_at(found, -1)) == 0, found).otherwise(F.aggregate(F.sequence(F.lit(1), deepest), found, step))

    # the text is searched only for what nests deeper than a few levels
    below = F.flatten(F.aggregate(F.sequence(F.lit(1), F.lit(_FEW_LEVELS)), F.array("_near"), step, rest))
    start = first.select("bom_id", F.struct("pointer", "parent_pointer", "parent_ref", F.lit(0).alias("depth"), "role", "v").alias("e"))
    # most elements hold none: they cost one look a member
    holders = dict.fromkeys(path.split(".")[1] for path, _, _ in children)
    held = start.select("bom_id", "e", *[F.try_variant_get("e.v", f"$.{h}", "variant").alias(f"_{h}") for h in holders])
    near = held.select("bom_id", "e", F.when(F.coalesce(*[F.col(f"_{h}") for h in holders]).isNotNull(), kids(F.col("e"))).alias("_near"))
    every = _inline(near, ["bom_id"], F.when(F.size("_near") > 0, F.concat(F.array("e"), below)).otherwise(F.array("e")))
    out = every.select("bom_id", "pointer", "parent_pointer", "parent_ref", "role", parsed(F.col("v"), shape).alias("c"), "depth", *(["v"] if with_members else []))
    if with_members:
        out = out.withColumn("members", F.map_keys(F.try_variant_get("v", "$", "map<string, variant>"))).drop("v")
    return out


ROLES = ("main", "inventory", "tool", "formula", "target", "annotator")


def _annotator(docs_col: Column, kind: str) -> Column:
    return _each(docs_col, lambda a, i: _item(a["annotator"][kind], "annotator", at("/annotations", i, "annotator", kind)))


def _shape_of(taken: tuple[str, ...]) -> str:
    """The component shape with some of its members."""
    return f"struct<{', '.join(f'`{n}` {kind}' for n, kind in _fields(D.COMPONENT) if n in taken)}>"


def component_elements(docs: DataFrame, roles: tuple[str, ...] = ROLES, with_members: bool = False, taken: tuple[str, ...] | None = None) -> DataFrame:
    """Every component at any depth. ``with_members`` adds the member names
    each element really has. ``taken`` names the members that the caller reads:
    ``c`` has those alone, so the others aren't cast from the element."""
    d = F.col("doc")
    tools = F.try_variant_get(d["metadata"]["tools"], "$.components", "array<variant>")
    starts = {
        "main": lambda: _item(d["metadata"]["component"], "main", "/metadata/component"),
        "inventory": lambda: _items(d["components"], "inventory", "/components"),
        "tool": lambda: _items(tools, "tool", "/metadata/tools/components"),
        "formula": lambda: _each(d["formulation"], lambda f, i: _items(f["components"], "formula", at("/formulation", i, "components"))),
        "target": lambda: _items(d["declarations"]["targets"]["components"], "target", "/declarations/targets/components"),
        "annotator": lambda: _annotator(d["annotations"], "component"),
    }
    return _levels(
        _starts(docs, [starts[r]() for r in roles]), D.COMPONENT if taken is None else _shape_of(taken),
        [("$.components", "components", None)]
        + [(f"$.pedigree.{n}", f"pedigree/{n}", n[:-1]) for n in ("ancestors", "descendants", "variants")],
        with_members,
    )


def service_elements(docs: DataFrame, with_members: bool = False) -> DataFrame:
    d = F.col("doc")
    tools = F.try_variant_get(d["metadata"]["tools"], "$.services", "array<variant>")
    first = _starts(docs, [
        _items(d["services"], "inventory", "/services"), _items(tools, "tool", "/metadata/tools/services"),
        _each(d["formulation"], lambda f, i: _items(f["services"], "formula", at("/formulation", i, "services"))),
        _items(d["declarations"]["targets"]["services"], "target", "/declarations/targets/services"),
        _annotator(d["annotations"], "service"),
    ])
    return _levels(first, D.SERVICE, [("$.services", "services", None)], with_members)


# ------------------------------------------------------------------ tables

def bom_table(docs: DataFrame) -> DataFrame:
    d = F.col("doc")
    m = d["metadata"]
    return docs.select(
        "bom_id", d["serialNumber"].alias("serial_number"), F.coalesce(d["version"].try_cast("int"), F.lit(1)).alias("version"),
        d["specVersion"].alias("spec_version"), ts(m["timestamp"]).alias("created_at"),
        F.coalesce(m["distributionConstraints"]["tlp"], F.lit("CLEAR")).alias("tlp"),
        F.try_variant_get(m["component"], "$['bom-ref']", "string").alias("main_component_ref"),
    )


def lifecycle_table(docs: DataFrame) -> DataFrame:
    return docs.select("bom_id", F.posexplode("doc.metadata.lifecycles").alias("position", "l")).select(
        "bom_id", "position", F.col("l.phase").alias("phase"), F.col("l.name").alias("name"), F.col("l.description").alias("description")
    )


def _place(elements: DataFrame) -> list[Column]:
    return [F.col(n) for n in ("bom_id", "pointer", "parent_pointer", "parent_ref", "depth", "role")]


#: Members that the component table takes.
FLAT = ("bom-ref", "type", "group", "name", "version", "versionRange", "isExternal", "scope", "purl", "cpe", "modified", "description", "publisher", "copyright", "supplier", "tags")


def flatten_components(elements: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The component table, defaults applied: scope required, not external.
    ``more`` names members of the element that are taken along."""
    c = F.col("c")
    taken = elements.select(
        *_place(elements), c["bom-ref"].alias("bom_ref"), c["type"].alias("type"),
        c["group"].alias("comp_group"), c["name"].alias("name"), c["version"].alias("version"), c["versionRange"].alias("version_range"),
        c["isExternal"].alias("is_external"), c["scope"].alias("scope"),
        c["purl"].alias("purl"), c["cpe"].alias("cpe"), c["modified"].alias("modified"), c["description"].alias("description"),
        c["publisher"].alias("publisher"), c["copyright"].alias("copyright"), c["supplier"]["name"].alias("supplier"),
        c["tags"].alias("tags"), *[c[m].alias(m) for m in more],
    )
    return taken.withColumns({"is_external": F.coalesce("is_external", F.lit(False)), "scope": F.coalesce("scope", F.lit("required"))})


def flatten_services(elements: DataFrame) -> DataFrame:
    c = F.col("c")
    return elements.select(
        *_place(elements), c["bom-ref"].alias("bom_ref"), c["group"].alias("service_group"),
        c["name"].alias("name"), c["version"].alias("version"), c["endpoints"].alias("endpoints"),
        c["authenticated"].alias("authenticated"), c["x-trust-boundary"].alias("x_trust_boundary"),
        c["trustZone"].alias("trust_zone"), c["provider"]["name"].alias("provider"), c["tags"].alias("tags"),
    )


def explode_dependencies(docs: DataFrame) -> DataFrame:
    """Edges of both kinds. A node without targets gives one row with
    ``declared_empty``: it is known to have none."""
    n = _spread(docs, ["bom_id"], "doc.dependencies", "_n", "n").select(
        "bom_id", F.col("n.ref").alias("ref"), F.coalesce("n.dependsOn", F.array().cast("array<string>")).alias("on"),
        F.coalesce("n.provides", F.array().cast("array<string>")).alias("prov"),
    )
    pairs = F.concat(
        F.transform("on", lambda t: F.struct(F.lit("dependsOn").alias("kind"), t.alias("target"))),
        F.transform("prov", lambda t: F.struct(F.lit("provides").alias("kind"), t.alias("target"))),
    )
    return (
        n.select("bom_id", "ref", F.explode_outer(pairs).alias("p"))
        .select("bom_id", "ref", F.coalesce("p.kind", F.lit("dependsOn")).alias("kind"), "p.target", F.col("p").isNull().alias("declared_empty"))
        .distinct()
    )


def _owned(elements: DataFrame) -> list[Column]:
    return [F.col("bom_id"), F.col("pointer").alias("owner_pointer"), F.col("c")["bom-ref"].alias("owner_ref")]


def _held(elements: DataFrame, *members: str) -> DataFrame:
    """The owner and plain members of each element. Of a struct made of columns
    (elements from XML) a select that only takes members makes no others."""
    return elements.select(*_owned(elements), *[F.col("c")[m].alias(m) for m in members])


def explode_hashes(elements: DataFrame) -> DataFrame:
    return _inline(elements, _owned(elements), "c.hashes").withColumnRenamed("content", "value")


_OWN = ["bom_id", "owner_pointer", "owner_ref"]


def _choices(licenses: Column, observed: bool) -> Column:
    """License choices of one owner as rows to be; null reads as none."""

    def row(l: Column, i: Column) -> Column:
        lic = l["license"]
        kind = F.when(lic["id"].isNotNull(), "id").when(lic["name"].isNotNull(), "name").when(
            l["expressionDetails"].isNotNull(), "expression-detailed"
        ).when(l["expression"].isNotNull(), "expression")
        return F.struct(
            i.alias("position"), kind.alias("kind"), F.coalesce(lic["id"], lic["name"], l["expression"]).alias("value"),
            F.coalesce(lic["acknowledgement"], l["acknowledgement"]).alias("acknowledgement"), F.lit(observed).alias("observed"),
            F.coalesce(lic["bom-ref"], l["bom-ref"]).alias("bom_ref"), F.coalesce(lic["licensing"], l["licensing"]).alias("licensing"),
            F.transform(l["expressionDetails"], lambda d: d["licenseIdentifier"]).alias("detail_ids"),
        )

    return F.transform(F.coalesce(licenses, F.array().cast(D.LICENSES)), row)


def explode_licenses(elements: DataFrame, with_contracts: bool = False) -> DataFrame:
    """License choices of every owner in one shape; ``observed`` marks those found as evidence."""
    choices, members = _choices(F.col("licenses"), False), ["licenses"]
    if "evidence" in elements.schema["c"].dataType.names:
        choices = F.concat(choices, _choices(parsed(F.col("evidence"), D.EVIDENCE)["licenses"], True))
        members.append("evidence")
    out = _inline(_held(elements, *members), _OWN, choices)
    return out if with_contracts else out.drop("licensing")


def explode_license_contracts(license_uses: DataFrame) -> DataFrame:
    g = F.col("licensing")
    who = lambda m: F.coalesce(g[m]["organization"]["name"], g[m]["individual"]["name"]).alias(m)
    return license_uses.filter(g.isNotNull()).select(
        *_OWN, F.col("value").alias("license"), who("licensor"), who("licensee"), who("purchaser"),
        g["purchaseOrder"].alias("purchase_order"), g["licenseTypes"].alias("license_types"), g["altIds"].alias("alt_ids"),
        ts(g["lastRenewal"]).alias("last_renewal"), ts(g["expiration"]).alias("expiration"),
    )


_REF = "array<struct<owner_pointer string, owner_ref string, position int, type string, url string, comment string, hashes array<struct<alg string, content string>>>>"


def _refs(refs: Column, owner: Column, ref: Column) -> Column:
    """References of one owner as rows to be; null reads as none."""
    return F.coalesce(F.transform(refs, lambda r, i: F.struct(
        owner.alias("owner_pointer"), ref.alias("owner_ref"), i.alias("position"), r["type"].alias("type"), r["url"].alias("url"),
        r["comment"].alias("comment"), r["hashes"].alias("hashes"),
    )).cast(_REF), F.array().cast(_REF))


def explode_external_references(docs: DataFrame, components: DataFrame, services: DataFrame) -> DataFrame:
    """References of the document, components, services, claims, standards and
    patents; one pass over each frame."""
    none, d = F.lit(None).cast("string"), F.col("doc")
    own = _refs(F.col("externalReferences"), F.col("owner_pointer"), F.col("owner_ref"))

    def inner(outer: Column, body) -> Column:
        return F.coalesce(F.flatten(F.transform(outer, body)), F.array().cast(_REF))

    def of(path: Column, prefix: str) -> Column:
        return inner(path, lambda x, i: _refs(x["externalReferences"], at(prefix, i), x["bom-ref"]))

    used = parsed(F.col("modelCard"), D.MODEL_CARD)["considerations"]["environmentalConsiderations"]["energyConsumptions"]
    place = "modelCard/considerations/environmentalConsiderations/energyConsumptions"
    energy = inner(used, lambda e, a: inner(e["energyProviders"], lambda p, b: _refs(
        p["externalReferences"], at(F.col("owner_pointer"), place, a, "energyProviders", b), p["bom-ref"]
    )))
    return _union([
        _inline(docs, ["bom_id"], F.concat(
            _refs(d["externalReferences"], F.lit(""), none), of(d["declarations"]["claims"], "/declarations/claims"),
            of(d["definitions"]["standards"], "/definitions/standards"), of(d["definitions"]["patents"], "/definitions/patents"),
        )),
        _inline(_held(components, "externalReferences", "modelCard"), ["bom_id"], F.concat(own, energy)),
        _inline(_held(services, "externalReferences"), ["bom_id"], own),
    ])


def _props(frame: DataFrame, props: Column, owner: Column, ref: Column) -> DataFrame:
    return _spread(frame, ["bom_id", owner.alias("owner_pointer"), ref.alias("owner_ref")], props, "position", "p").select(
        "bom_id", "owner_pointer", "owner_ref", "position", F.col("p.name").alias("name"), F.col("p.value").alias("value")
    )


def explode_properties(docs: DataFrame, components: DataFrame | None = None, services: DataFrame | None = None) -> DataFrame:
    """Name/value rows of every object that has properties, in document order;
    names may repeat. All owners come from one walk over ``docs``; the element
    frames are taken for older callers and not read."""
    return shred.properties_of(shred.objects(docs, shred.WANTED_PROPERTIES))


def explode_identifiers(elements: DataFrame) -> DataFrame:
    c = {m: F.col(m) for m in ("purl", "cpe", "swid", "omniborId", "swhid")}
    single = lambda k, v: F.when(v.isNotNull(), F.array(F.struct(F.lit(k).alias("kind"), v.alias("value"))))
    many = lambda k, v: F.transform(v, lambda x: F.struct(F.lit(k).alias("kind"), x.alias("value")))
    none = F.array().cast("array<struct<kind string, value string>>")
    lists = [
        single("purl", c["purl"]), single("cpe", c["cpe"]), single("swid", c["swid"]["tagId"]), many("omnibor", c["omniborId"]),
        many("swhid", c["swhid"]),
    ]
    return _inline(_held(elements, *c), _OWN, F.concat(*[F.coalesce(x, none) for x in lists]))


# ------------------------------------------------------------------ evidence

def _evidence(elements: DataFrame) -> DataFrame:
    """Elements without evidence have a null ``e``; its lists give no rows."""
    return _held(elements, "evidence").select(*_OWN, parsed(F.col("evidence"), D.EVIDENCE).alias("e"))


def evidence_identity(elements: DataFrame) -> DataFrame:
    """Identity may be one object or a list."""
    e = _evidence(elements)
    v = F.col("e.identity")
    listed = F.coalesce(
        F.try_variant_get(v, "$", f"array<{D.EVIDENCE_IDENTITY}>"), F.array(parsed(v, D.EVIDENCE_IDENTITY))
    )
    return _spread(e, _OWN, F.when(v.isNotNull(), listed), "position", "i").select(
        *_OWN, "position", F.col("i.field").alias("field"), F.col("i.confidence").alias("confidence"),
        F.col("i.concludedValue").alias("concluded_value"), F.col("i.methods").alias("methods"), F.col("i.tools").alias("tools"),
    )


def evidence_methods(identities: DataFrame) -> DataFrame:
    return _spread(identities, [*_OWN, "field"], "methods", "method_position", "m").select(
        *_OWN, "field", "method_position", F.col("m.technique").alias("technique"), F.col("m.confidence").alias("confidence"),
        F.col("m.value").alias("value"),
    )


def evidence_occurrences(elements: DataFrame) -> DataFrame:
    return _spread(_evidence(elements), _OWN, "e.occurrences", "position", "o").select(
        *_OWN, "position", F.col("o")["bom-ref"].alias("bom_ref"), "o.location", "o.line", "o.offset", "o.symbol",
        F.col("o.additionalContext").alias("additional_context"),
    )


def evidence_frames(elements: DataFrame) -> DataFrame:
    return _spread(_evidence(elements), _OWN, "e.callstack.frames", "position", "f").select(
        *_OWN, "position", "f.package", "f.module", "f.function", "f.parameters", "f.line", "f.column",
        F.col("f.fullFilename").alias("full_filename"),
    )


def evidence_copyright(elements: DataFrame) -> DataFrame:
    return _spread(_evidence(elements), _OWN, "e.copyright", "position", "x").select(*_OWN, "position", "x.text")


# ------------------------------------------------------------------ pedigree, issues, notes

def _pedigree(elements: DataFrame) -> DataFrame:
    return _held(elements, "pedigree").filter("pedigree IS NOT NULL").select(*_OWN, parsed(F.col("pedigree"), D.PEDIGREE).alias("p"))


def pedigree_commits(elements: DataFrame) -> DataFrame:
    k = F.col("k")
    return _pedigree(elements).select(*_OWN, F.posexplode("p.commits").alias("position", "k")).select(
        *_OWN, "position", "k.uid", "k.url", k["author"]["name"].alias("author"), ts(k["author"]["timestamp"]).alias("authored_at"),
        k["committer"]["name"].alias("committer"), ts(k["committer"]["timestamp"]).alias("committed_at"), "k.message",
    )


def pedigree_patches(elements: DataFrame) -> DataFrame:
    k = F.col("k")
    return _pedigree(elements).select(*_OWN, F.posexplode("p.patches").alias("position", "k")).select(
        *_OWN, "position", "k.type", k["diff"]["url"].alias("diff_url"), k["diff"]["text"]["content"].alias("diff_text"),
        F.col("k.resolves").alias("resolves"),
    )


def pedigree_issues(patches: DataFrame) -> DataFrame:
    return patches.select(*_OWN, F.col("position").alias("patch_position"), F.explode("resolves").alias("r")).select(
        *_OWN, "patch_position", "r.type", "r.id", "r.name", F.col("r.source.name").alias("source_name"), "r.references"
    )


def pedigree_relations(elements: DataFrame) -> DataFrame:
    """Ancestor, descendant and variant edges between package urls."""
    rel = elements.filter(F.col("role").isin("ancestor", "descendant", "variant"))
    own = elements.select("bom_id", F.col("pointer").alias("parent_pointer"), F.col("c.purl").alias("_of"))
    j = rel.select("bom_id", "parent_pointer", "role", F.col("c.purl").alias("_other")).join(own, ["bom_id", "parent_pointer"])
    older = F.col("role") == "ancestor"
    return j.filter("_of IS NOT NULL AND _other IS NOT NULL").select(
        "bom_id", F.when(older, F.col("_other")).otherwise(F.col("_of")).alias("src"),
        F.when(older, F.col("_of")).otherwise(F.col("_other")).alias("dst"), F.col("role").alias("kind"),
    )


def release_notes(elements: DataFrame) -> DataFrame:
    n = elements.filter("c.releaseNotes IS NOT NULL").select(*_owned(elements), parsed(F.col("c.releaseNotes"), D.RELEASE_NOTES).alias("n"))
    return n.select(
        *_OWN, "n.type", "n.title", "n.description", ts(F.col("n.timestamp")).alias("released_at"), "n.aliases", "n.tags", "n.resolves", "n.notes"
    )


def release_note_texts(notes: DataFrame) -> DataFrame:
    return notes.select(*_OWN, F.posexplode("notes").alias("position", "t")).select(
        *_OWN, "position", "t.locale", F.col("t.text.content").alias("text")
    )


def release_note_issues(notes: DataFrame) -> DataFrame:
    return notes.select(*_OWN, F.explode("resolves").alias("r")).select(*_OWN, "r.type", "r.id", "r.name")


# ------------------------------------------------------------------ vulnerabilities

def vulnerability_rows(docs: DataFrame) -> DataFrame:
    return docs.select("bom_id", F.posexplode("doc.vulnerabilities").alias("position", "v"))


def explode_vulnerabilities(docs: DataFrame) -> dict[str, DataFrame]:
    """The vulnerability table and its child tables."""
    v = vulnerability_rows(docs)
    key = ["bom_id", "position"]
    x = F.col("v")
    an = x["analysis"]

    def kids(member: str, alias: str) -> DataFrame:
        return v.select(*key, F.posexplode(x[member]).alias("child_position", alias))

    versions = kids("affects", "a").select(*key, F.col("a.ref").alias("ref"), F.explode_outer("a.versions").alias("w"))
    credits = [
        v.select(*key, F.lit(kind).alias("kind"), F.explode(x["credits"][member]).alias("p")).select(*key, "kind", "p.name")
        for kind, member in (("organization", "organizations"), ("individual", "individuals"))
    ]
    return {
        "vulnerability": v.select(
            *key, x["bom-ref"].alias("bom_ref"), x["id"].alias("id"), x["source"]["name"].alias("source_name"),
            x["description"].alias("description"), x["recommendation"].alias("recommendation"), x["workaround"].alias("workaround"),
            ts(x["created"]).alias("created_at"), ts(x["published"]).alias("published_at"), ts(x["updated"]).alias("updated_at"),
            ts(x["rejected"]).alias("rejected_at"), x["proofOfConcept"]["environment"].alias("poc_environment"),
        ),
        "alias": kids("references", "r").select(*key, F.col("r.id").alias("alias"), F.col("r.source.name").alias("source_name")),
        "rating": kids("ratings", "r").select(
            *key, "child_position", F.col("r.source.name").alias("source_name"), "r.score", "r.severity", "r.method", "r.vector"
        ),
        "cwe": v.select(*key, F.explode(x["cwes"]).alias("cwe")),
        "advisory": kids("advisories", "r").select(*key, "r.title", "r.url"),
        "affects": versions.select(
            *key, "ref", F.col("w.version").alias("version"), F.col("w.range").alias("vers_range"),
            F.coalesce("w.status", F.lit("affected")).alias("status"),
        ),
        "analysis": v.filter(an.isNotNull()).select(
            *key, an["state"].alias("state"), an["justification"].alias("justification"), an["response"].alias("response"),
            ts(an["firstIssued"]).alias("first_issued"), ts(an["lastUpdated"]).alias("last_updated"),
        ),
        "credit": _union(credits),
    }


# ------------------------------------------------------------------ other document sections

def explode_annotations(docs: DataFrame) -> DataFrame:
    a = docs.select("bom_id", F.posexplode("doc.annotations").alias("position", "a"))
    w = F.col("a.annotator")
    name = lambda m: F.try_variant_get(w[m], "$.name", "string")
    kind = F.when(w["organization"].isNotNull(), "organization").when(w["individual"].isNotNull(), "individual").when(
        w["component"].isNotNull(), "component").when(w["service"].isNotNull(), "service")
    return a.select(
        "bom_id", "position", F.col("a")["bom-ref"].alias("bom_ref"), F.explode_outer("a.subjects").alias("subject"), kind.alias("annotator_kind"),
        F.coalesce(w["organization"]["name"], w["individual"]["name"], name("component"), name("service")).alias("annotator"),
        ts(F.col("a.timestamp")).alias("annotated_at"), F.col("a.text").alias("text"),
    )


def explode_compositions(docs: DataFrame) -> DataFrame:
    c = _spread(docs, ["bom_id"], "doc.compositions", "position", "c")
    kinds = [("assembly", "assemblies"), ("dependency", "dependencies"), ("vulnerability", "vulnerabilities")]
    members = F.concat(*[
        _tagged(k, "member_kind", F.coalesce(F.col("c")[m], F.array().cast("array<string>")), "ref") for k, m in kinds
    ])
    return c.select(
        "bom_id", "position", F.coalesce("c.aggregate", F.lit("not_specified")).alias("aggregate"), F.inline(members)
    )


def explode_formulation(docs: DataFrame) -> dict[str, DataFrame]:
    f = _spread(docs, ["bom_id"], "doc.formulation", "_f", "f")
    w = _spread(f, ["bom_id"], "f.workflows", "_w", "w").drop("_w")
    x = F.col("w")
    t = _spread(w, ["bom_id", x["bom-ref"].alias("workflow_ref")], x["tasks"], "position", "t")
    y = F.col("t")
    cols = ["trigger", "steps", "inputs", "outputs", "workspaces"]

    def run(r: Column, kind: str) -> Column:
        return F.struct(r["bom-ref"].alias("owner_ref"), F.lit(kind).alias("owner_kind"), *[r[c].alias(c) for c in cols])

    # a workflow and its tasks out of one row
    tasks = F.transform(x["tasks"], lambda r: run(r, "task"))
    runs = _inline(w, ["bom_id"], F.concat(F.array(run(x, "workflow")), F.when(x["tasks"].isNotNull(), tasks).otherwise(F.slice(F.array(run(x, "task")), 1, 0))))
    own = ["bom_id", "owner_ref", "owner_kind"]
    steps = _spread(runs, own, "steps", "position", "s")

    def res(c: Column) -> Column:
        return F.coalesce(c["ref"], c["externalReference"]["url"])

    _io = "array<struct<position int, direction string, type string, source string, target string, resource string>>"

    def io(member: str, direction: str) -> Column:
        return F.coalesce(F.transform(member, lambda i, n: F.struct(
            n.alias("position"), F.lit(direction).alias("direction"), (i["type"] if direction == "output" else F.lit(None).cast("string")).alias("type"),
            res(i["source"]).alias("source"), res(i["target"]).alias("target"), res(i["resource"]).alias("resource"),
        )).cast(_io), F.array().cast(_io))

    trig = runs.filter("trigger IS NOT NULL").select(*own, F.col("trigger").alias("g"))
    spaces = _spread(runs, own, "workspaces", "_n", "s")
    return {
        "workflow": w.select(
            "bom_id", x["bom-ref"].alias("bom_ref"), x["uid"].alias("uid"), x["name"].alias("name"), x["taskTypes"].alias("task_types"),
            ts(x["timeStart"]).alias("time_start"), ts(x["timeEnd"]).alias("time_end"),
        ),
        "task": t.select(
            "bom_id", "workflow_ref", "position", y["bom-ref"].alias("bom_ref"), y["uid"].alias("uid"), y["name"].alias("name"),
            y["taskTypes"].alias("task_types"), ts(y["timeStart"]).alias("time_start"), ts(y["timeEnd"]).alias("time_end"),
        ),
        "task_edge": _spread(w, ["bom_id", x["bom-ref"].alias("workflow_ref")], x["taskDependencies"], "_n", "e").select(
            "bom_id", "workflow_ref", F.col("e.ref").alias("ref"), F.explode_outer("e.dependsOn").alias("target")
        ),
        "step": steps.select(*own, "position", "s.name", "s.description"),
        "command": _spread(steps, [*own, F.col("position").alias("step_position")], "s.commands", "position", "k").select(
            *own, "step_position", "position", F.col("k.executed").alias("executed")
        ),
        "task_io": _inline(runs, own, F.concat(io("inputs", "input"), io("outputs", "output"))),
        "trigger": trig.select(
            *own, F.col("g")["bom-ref"].alias("bom_ref"), "g.uid", "g.type", ts(F.col("g.timeActivated")).alias("activated_at"),
            F.col("g.event.uid").alias("event_uid"), ts(F.col("g.event.timeReceived")).alias("event_received_at"),
        ),
        "condition": _spread(trig, own, "g.conditions", "_n", "k").select(*own, "k.description", "k.expression"),
        "workspace": spaces.select(
            *own, F.col("s")["bom-ref"].alias("bom_ref"), "s.uid", "s.name", F.col("s.accessMode").alias("access_mode"),
            F.col("s.mountPath").alias("mount_path"), F.col("s.volume.uid").alias("volume_uid"), F.col("s.volume.mode").alias("volume_mode"),
            F.col("s.volume.sizeAllocated").alias("size_allocated"),
        ),
    }


def explode_declarations(docs: DataFrame) -> dict[str, DataFrame]:
    d = F.col("doc.declarations")
    m = _spread(
        _spread(docs, ["bom_id"], d["attestations"], "attestation", "a"), ["bom_id", "attestation", F.col("a.assessor").alias("assessor")], "a.map", "position", "m"
    )
    claims = _spread(docs, ["bom_id"], d["claims"], "_n", "k")
    evidence = _spread(docs, ["bom_id"], d["evidence"], "_n", "e")
    links = F.concat(
        F.transform(F.coalesce("m.claims", F.array().cast("array<string>")), lambda r: F.struct(F.lit(False).alias("counter"), r.alias("claim"))),
        F.transform(F.coalesce("m.counterClaims", F.array().cast("array<string>")), lambda r: F.struct(F.lit(True).alias("counter"), r.alias("claim"))),
    )
    proof = F.concat(
        F.transform(F.coalesce("k.evidence", F.array().cast("array<string>")), lambda r: F.struct(F.lit(False).alias("counter"), r.alias("evidence"))),
        F.transform(F.coalesce("k.counterEvidence", F.array().cast("array<string>")), lambda r: F.struct(F.lit(True).alias("counter"), r.alias("evidence"))),
    )
    return {
        "assessor": _spread(docs, ["bom_id"], d["assessors"], "_n", "x").select(
            "bom_id", F.col("x")["bom-ref"].alias("bom_ref"), F.coalesce("x.thirdParty", F.lit(False)).alias("third_party"),
            F.col("x.organization.name").alias("organization"),
        ),
        "attestation_map": m.select(
            "bom_id", "attestation", "assessor", "position", F.col("m.requirement").alias("requirement"),
            F.col("m.conformance.score").alias("conformance_score"), F.col("m.confidence.score").alias("confidence_score"),
        ),
        "map_claim": m.select("bom_id", "attestation", "position", F.col("m.requirement").alias("requirement"), F.inline(links)),
        "claim": claims.select(
            "bom_id", F.col("k")["bom-ref"].alias("bom_ref"), "k.target", "k.predicate", "k.reasoning",
        ),
        "claim_evidence": claims.select("bom_id", F.col("k")["bom-ref"].alias("claim"), F.inline(proof)),
        "evidence": evidence.select(
            "bom_id", F.col("e")["bom-ref"].alias("bom_ref"), F.col("e.propertyName").alias("property_name"), "e.description",
            ts(F.col("e.created")).alias("created_at"), ts(F.col("e.expires")).alias("expires_at"), F.col("e.author.name").alias("author"),
        ),
        "affirmation": docs.filter(d["affirmation"].isNotNull()).select(
            "bom_id", d["affirmation"]["statement"].alias("statement"), F.explode_outer(d["affirmation"]["signatories"]).alias("s")
        ).select("bom_id", "statement", F.col("s.name").alias("signatory"), F.col("s.role").alias("role")),
    }


def explode_standards(docs: DataFrame) -> dict[str, DataFrame]:
    s = docs.select("bom_id", F.posexplode("doc.definitions.standards").alias("position", "s"))
    ref = F.col("s")["bom-ref"].alias("standard_ref")
    return {
        "standard": s.select("bom_id", F.col("s")["bom-ref"].alias("bom_ref"), "s.name", "s.version", "s.owner"),
        "requirement": s.select("bom_id", ref, F.explode("s.requirements").alias("r")).select(
            "bom_id", "standard_ref", F.col("r")["bom-ref"].alias("bom_ref"), "r.identifier", "r.title", "r.parent",
            F.col("r.openCre").alias("open_cre"),
        ),
        "level_requirement": s.select("bom_id", ref, F.explode("s.levels").alias("l")).select(
            "bom_id", "standard_ref", F.col("l")["bom-ref"].alias("level_ref"), F.col("l.identifier").alias("level"),
            F.explode_outer("l.requirements").alias("requirement"),
        ),
    }


def explode_patents(docs: DataFrame, elements: DataFrame) -> dict[str, DataFrame]:
    p = docs.select("bom_id", F.explode("doc.definitions.patents").alias("p"))
    family = F.col("p.familyId").isNotNull()
    a = elements.select(*_owned(elements), F.posexplode("c.patentAssertions").alias("position", "a"))
    w = F.col("a.asserter")
    text = lambda path: F.try_variant_get(w, path, "string")
    ref = F.coalesce(text("$.ref"), F.when(F.schema_of_variant(w) == "STRING", text("$")))
    person = F.coalesce(text("$.individual.name"), F.when(text("$.email").isNotNull() | text("$.phone").isNotNull(), text("$.name")))
    org = F.coalesce(text("$.organization.name"), text("$.name"))
    kind = F.when(ref.isNotNull(), "ref").when(person.isNotNull(), "individual").when(org.isNotNull(), "organization")
    return {
        "patent": p.filter(~family).select(
            "bom_id", F.col("p")["bom-ref"].alias("ref"), F.col("p.patentNumber").alias("patent_number"), "p.jurisdiction", "p.title",
            F.col("p.patentLegalStatus").alias("legal_status"), ts(F.col("p.filingDate")).alias("filed_at"),
            ts(F.col("p.grantDate")).alias("granted_at"), ts(F.col("p.patentExpirationDate")).alias("expires_at"),
        ),
        "patent_family_member": p.filter(family).select(
            "bom_id", F.col("p")["bom-ref"].alias("family_ref"), F.col("p.familyId").alias("family_id"), F.explode("p.members").alias("member")
        ),
        "patent_assertion": a.select(
            *_OWN, F.col("a.assertionType").alias("assertion_type"), kind.alias("asserter_kind"), F.coalesce(ref, person, org).alias("asserter"),
            F.explode_outer("a.patentRefs").alias("target"),
        ),
    }


# ------------------------------------------------------------------ crypto, models, data

def crypto_assets(elements: DataFrame) -> DataFrame:
    return elements.filter("c.cryptoProperties IS NOT NULL").select(
        "bom_id", F.col("c")["bom-ref"].alias("ref"), F.col("c.name").alias("name"), parsed(F.col("c.cryptoProperties"), D.CRYPTO).alias("p")
    )


def explode_crypto(elements: DataFrame) -> dict[str, DataFrame]:
    k = crypto_assets(elements)
    p = F.col("p")
    al, ce, ma, pr = p["algorithmProperties"], p["certificateProperties"], p["relatedCryptoMaterialProperties"], p["protocolProperties"]
    own = ["bom_id", "ref"]
    suites = k.select(*own, F.posexplode(pr["cipherSuites"]).alias("position", "s"))
    no = F.array().cast("array<struct<relation string, target string>>")

    def rel(name: str, target: Column) -> Column:
        return F.when(target.isNotNull(), F.array(F.struct(F.lit(name).alias("relation"), target.alias("target"))))

    def rels(name: str, targets: Column) -> Column:
        return F.transform(targets, lambda t: F.struct(F.lit(name).alias("relation"), t.alias("target")))

    def assets(owner: Column) -> Column:
        return F.transform(owner["relatedCryptographicAssets"], lambda a: F.struct(F.concat(F.lit("asset:"), a["type"]).alias("relation"), a["ref"].alias("target")))

    suite_algs = F.flatten(F.transform(pr["cipherSuites"], lambda s: F.coalesce(s["algorithms"], F.array().cast("array<string>"))))
    relations = F.concat(*[
        F.coalesce(x, no) for x in (
            rel("signatureAlgorithm", ce["signatureAlgorithmRef"]), rel("subjectPublicKey", ce["subjectPublicKeyRef"]),
            rel("algorithm", ma["algorithmRef"]), rel("securedBy", ma["securedBy"]["algorithmRef"]), rels("cipherSuite", suite_algs),
            rels("crypto", pr["cryptoRefArray"]), assets(ce), assets(ma), assets(pr),
        )
    ])

    # transforms of all kinds out of one row; assets without any give no rows, so the elements needn't be filtered first
    kinds = ("encr", "prf", "integ", "ke", "auth")
    held = elements.select("bom_id", F.col("c")["bom-ref"].alias("ref"), parsed(F.col("c.cryptoProperties"), D.CRYPTO)["protocolProperties"]["ikev2TransformTypes"].alias("t"))
    listed = F.concat(*[
        F.coalesce(
            F.transform(F.col("t")[kind], lambda v, i: F.struct(F.lit(kind).alias("transform"), i.alias("position"), v.alias("v"))),  # noqa: B023
            F.array().cast("array<struct<transform string, position int, v variant>>"),
        )
        for kind in kinds
    ])
    v = F.col("v")
    plain = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    get = lambda path, ty="string": F.try_variant_get(v, path, ty)
    transforms = _inline(held, own, listed).select(
        *own, "transform", "position", F.coalesce(get("$.name"), get("$.group")).alias("name"),
        get("$.keyLength", "int").alias("key_length"), F.coalesce(plain, get("$.algorithm")).alias("algorithm"),
    )

    return {
        "crypto_asset": k.select(*own, "name", p["assetType"].alias("asset_type"), p["oid"].alias("oid")),
        "crypto_algorithm": k.filter(al.isNotNull()).select(
            *own, "name", al["primitive"].alias("primitive"), al["algorithmFamily"].alias("family"), F.coalesce(al["ellipticCurve"], al["curve"]).alias("curve"),
            al["parameterSetIdentifier"].alias("parameter_set"), al["mode"].alias("mode"), al["padding"].alias("padding"),
            al["cryptoFunctions"].alias("functions"), al["classicalSecurityLevel"].alias("classical_level"),
            al["nistQuantumSecurityLevel"].alias("nist_quantum_level"),
        ),
        "crypto_certificate": k.filter(ce.isNotNull()).select(
            *own, ce["serialNumber"].alias("serial_number"), ce["subjectName"].alias("subject_name"), ce["issuerName"].alias("issuer_name"),
            ts(ce["notValidBefore"]).alias("not_valid_before"), ts(ce["notValidAfter"]).alias("not_valid_after"),
            ts(ce["revocationDate"]).alias("revoked_at"), ts(ce["destructionDate"]).alias("destroyed_at"),
        ),
        "crypto_cert_state": k.select(*own, F.posexplode(ce["certificateState"]).alias("position", "s")).select(
            *own, "position", F.coalesce("s.state", "s.name").alias("state"), "s.reason"
        ),
        "crypto_cert_extension": k.select(*own, F.explode(ce["certificateExtensions"]).alias("x")).select(
            *own, F.col("x.commonExtensionName").isNotNull().alias("common"),
            F.coalesce("x.commonExtensionName", "x.customExtensionName").alias("name"),
            F.coalesce("x.commonExtensionValue", "x.customExtensionValue").alias("value"),
        ),
        "crypto_material": k.filter(ma.isNotNull()).select(
            *own, ma["type"].alias("type"), ma["state"].alias("state"), ma["size"].alias("size"), ma["format"].alias("format"),
            ts(ma["expirationDate"]).alias("expires_at"), ma["securedBy"]["mechanism"].alias("mechanism"),
        ),
        "crypto_protocol": k.filter(pr.isNotNull()).select(*own, pr["type"].alias("type"), pr["version"].alias("version")),
        "crypto_cipher_suite": suites.select(*own, "position", F.col("s.name").alias("suite"), F.explode_outer("s.algorithms").alias("algorithm")),
        "crypto_transform": transforms,
        "crypto_relation": k.select("bom_id", F.col("ref").alias("from_ref"), F.inline(relations)),
    }


def model_cards(elements: DataFrame) -> DataFrame:
    return elements.filter("c.modelCard IS NOT NULL").select(*_owned(elements), parsed(F.col("c.modelCard"), D.MODEL_CARD).alias("m"))


def explode_model_cards(elements: DataFrame) -> dict[str, DataFrame]:
    k = model_cards(elements)
    m = F.col("m")
    con, par = m["considerations"], m["modelParameters"]
    e = k.select(*_OWN, F.posexplode(con["environmentalConsiderations"]["energyConsumptions"]).alias("position", "e"))
    v = F.col("v")
    texts = ["users", "useCases", "technicalLimitations", "performanceTradeoffs"]
    return {
        "model_card": k.select(
            *_OWN, par["approach"]["type"].alias("approach"), par["task"].alias("task"), par["architectureFamily"].alias("architecture_family"),
            par["modelArchitecture"].alias("model_architecture"),
        ),
        "model_metric": k.select(*_OWN, F.posexplode(m["quantitativeAnalysis"]["performanceMetrics"]).alias("position", "q")).select(
            *_OWN, "position", "q.type", "q.value", "q.slice", F.col("q.confidenceInterval.lowerBound").alias("lower_bound"),
            F.col("q.confidenceInterval.upperBound").alias("upper_bound"),
        ),
        "model_dataset": k.select(*_OWN, F.posexplode(par["datasets"]).alias("position", "v")).select(
            *_OWN, "position", F.try_variant_get(v, "$.ref", "string").alias("ref"), F.try_variant_get(v, "$.name", "string").alias("name"),
            F.try_variant_get(v, "$.type", "string").alias("type"),
        ),
        "model_energy": e.select(
            *_OWN, "position", "e.activity", F.col("e.activityEnergyCost.value").alias("kwh"),
            F.col("e.co2CostEquivalent.value").alias("co2_cost_t"), F.col("e.co2CostOffset.value").alias("co2_offset_t"),
        ),
        "model_energy_provider": e.select(*_OWN, "position", F.col("e.activity").alias("activity"), F.explode("e.energyProviders").alias("p")).select(
            *_OWN, "position", "activity", F.col("p.energySource").alias("energy_source"), F.col("p.organization.name").alias("organization"),
            F.col("p.energyProvided.value").alias("provided_kwh"),
        ),
        "model_fairness": k.select(*_OWN, F.explode(con["fairnessAssessments"]).alias("f")).select(
            *_OWN, F.col("f.groupAtRisk").alias("group_at_risk"), "f.benefits", "f.harms", F.col("f.mitigationStrategy").alias("mitigation")
        ),
        "model_consideration": _union([
            k.select(*_OWN, F.lit(t).alias("kind"), F.posexplode(con[t]).alias("position", "text")) for t in texts
        ]),
    }


def component_data(elements: DataFrame) -> DataFrame:
    """``data`` is one object before 1.6 and a list after."""
    v = F.col("c.data")
    listed = F.coalesce(F.try_variant_get(v, "$", f"array<{D.COMPONENT_DATA}>"), F.array(parsed(v, D.COMPONENT_DATA)))
    return elements.filter(v.isNotNull()).select(*_owned(elements), F.posexplode(listed).alias("position", "d"))


def explode_component_data(elements: DataFrame) -> DataFrame:
    return component_data(elements).select(
        *_OWN, "position", "d.type", "d.name", "d.classification", F.col("d.contents.url").alias("url"), F.col("d.sensitiveData").alias("sensitive_data")
    )


def explode_data_governance(elements: DataFrame) -> DataFrame:
    """(data pointer, role, party)."""
    d = component_data(elements).select(
        "bom_id", at(F.col("owner_pointer"), "data", F.col("position")).alias("data_pointer"), F.col("owner_ref"), F.col("d.governance").alias("g")
    )
    roles = F.concat(*[
        _tagged(
            m[:-1], "role", F.coalesce(F.col("g")[m], F.array().cast(f"array<{D.GOVERNANCE_PARTY}>")), "party",
            lambda p: F.coalesce(p["organization"]["name"], p["contact"]["name"]),
        )
        for m in ("custodians", "stewards", "owners")
    ])
    return d.filter("g IS NOT NULL").select("bom_id", "data_pointer", "owner_ref", F.inline(roles))


def explode_data_flows(services: DataFrame) -> DataFrame:
    f = services.select(*_owned(services), F.posexplode("c.data").alias("position", "d"))
    return (
        f.select(*_OWN, "position", F.col("d.flow").alias("direction"), "d.classification", "d.name",
                 F.explode_outer("d.source").alias("source"), F.col("d.destination").alias("_to"))
        .select(*_OWN, "position", "direction", "classification", "name", "source", F.explode_outer("_to").alias("destination"))
    )


#: Members of components that hold parties.
PARTIES = ("bom-ref", "supplier", "manufacturer", "authors", "author", "publisher")
_PARTY = "array<struct<owner_pointer string, role string, kind string, name string, country string, region string, email string>>"


def explode_parties(docs: DataFrame, components: DataFrame, services: DataFrame) -> DataFrame:
    """Organizations and people with the part they play; one pass over each frame."""
    nothing = F.array().cast(_PARTY)

    def one(owner: Column, role: str, kind: str, name: Column, country=F.lit(None), region=F.lit(None), email=F.lit(None)) -> Column:
        fields = {"owner_pointer": owner, "role": F.lit(role), "kind": F.lit(kind), "name": name, "country": country, "region": region, "email": email}
        return F.struct(*[v.cast("string").alias(n) for n, v in fields.items()])

    def org(c: Column, role: str, owner: Column) -> Column:
        row = one(owner, role, "organization", c["name"], c["address"]["country"], c["address"]["region"])
        return F.when(c.isNotNull(), F.array(row)).otherwise(nothing)

    def people(c: Column, role: str, owner: Column) -> Column:
        return F.coalesce(F.transform(c, lambda p: one(owner, role, "individual", p["name"], email=p["email"])), nothing)

    def text(c: Column, role: str, owner: Column) -> Column:
        return F.when(c.isNotNull(), F.array(one(owner, role, "text", c))).otherwise(nothing)

    m, root, own = F.col("doc.metadata"), F.lit("/metadata"), F.col("owner_pointer")
    return _union([
        _inline(docs, ["bom_id"], F.concat(
            org(m["supplier"], "supplier", root), org(F.coalesce(m["manufacturer"], m["manufacture"]), "manufacturer", root), people(m["authors"], "author", root),
        )),
        _inline(_held(components, "supplier", "manufacturer", "authors", "author", "publisher"), ["bom_id"], F.concat(
            org(F.col("supplier"), "supplier", own), org(F.col("manufacturer"), "manufacturer", own), people(F.col("authors"), "author", own),
            text(F.col("author"), "author", own), text(F.col("publisher"), "publisher", own), people(F.col("supplier.contact"), "supplier-contact", own),
        )),
        _inline(_held(services, "provider"), ["bom_id"], org(F.col("provider"), "provider", own)),
    ])


def explode_citations(docs: DataFrame) -> DataFrame:
    c = docs.select("bom_id", F.posexplode("doc.citations").alias("position", "c"))
    none = F.array().cast("array<string>")
    targets = F.concat(
        F.transform(F.coalesce("c.pointers", none), lambda p: F.struct(F.lit("pointer").alias("target_kind"), p.alias("target"))),
        F.transform(F.coalesce("c.expressions", none), lambda p: F.struct(F.lit("expression").alias("target_kind"), p.alias("target"))),
    )
    return c.select(
        "bom_id", "position", F.col("c")["bom-ref"].alias("bom_ref"), F.col("c.attributedTo").alias("attributed_to"), "c.process",
        ts(F.col("c.timestamp")).alias("cited_at"), F.inline_outer(targets),
    )


def pointer_table(docs: DataFrame) -> DataFrame:
    """(pointer, key, value type, scalar value) of every node of a document,
    by a level loop over ``variant_explode``."""
    frontier = docs.select("bom_id", F.lit("").alias("pointer"), F.lit(None).cast("string").alias("key"), F.try_parse_json("content").alias("v"))
    levels: list[DataFrame] = []
    while True:
        level = cut(frontier.filter("v IS NOT NULL").withColumn("_t", F.schema_of_variant("v")))
        if is_empty(level):
            break
        levels.append(level)
        step = "replace(replace(coalesce(e.key, CAST(e.pos AS STRING)), '~', '~0'), '/', '~1')"
        frontier = docs.sparkSession.sql(
            "SELECT l.bom_id, concat(l.pointer, '/', " + step + ") AS pointer, e.key AS key, e.value AS v "
            "FROM {level} l, LATERAL variant_explode(l.v) e WHERE l._t LIKE 'OBJECT%' OR l._t LIKE 'ARRAY%'",
            level=level,
        )
    kind = F.when(F.col("_t").startswith("OBJECT"), "object").when(F.col("_t").startswith("ARRAY"), "array").otherwise("scalar")
    scalar = F.when(kind == "scalar", F.try_variant_get("v", "$", "string"))
    return _union(levels).select("bom_id", "pointer", "key", kind.alias("kind"), scalar.alias("value"))


# ------------------------------------------------------------------ reference indexes

def bom_ref_index(docs: DataFrame, components: DataFrame | None = None, services: DataFrame | None = None) -> DataFrame:
    """Every declared ref with its kind of object and pointer, whatever the
    kind. One walk over ``docs``; the element frames are not read."""
    return shred.refs_of(shred.objects(docs, shred.wanted_refs()))


def ref_use_index(docs: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Every in-document reference with the field that holds it, one row a use.
    One walk over ``docs``; the element frame is not read."""
    return shred.uses_of(shred.objects(docs, shred.wanted_uses())).select("bom_id", "field", "target")


# ------------------------------------------------------------------ defaults, trees

DEFAULTS = {"scope": "required", "is_external": False, "version": 1, "tlp": "CLEAR", "aggregate": "not_specified", "status": "affected"}


def apply_defaults(df: DataFrame, columns: dict | None = None) -> DataFrame:
    """Fill the stated default where a column of that meaning is null."""
    for name, value in (columns or DEFAULTS).items():
        if name in df.columns:
            df = df.withColumn(name, F.coalesce(name, F.lit(value)))
    return df


def swid_table(elements: DataFrame) -> DataFrame:
    s = F.col("swid")
    return _held(elements, "swid").filter(s.isNotNull()).select(
        *_OWN, s["tagId"].alias("tag_id"), s["name"].alias("name"), F.coalesce(s["version"], F.lit("0.0")).alias("version"),
        F.coalesce(s["tagVersion"], F.lit(0)).alias("tag_version"), F.coalesce(s["patch"], F.lit(False)).alias("patch"),
    )


def assembly_tree(components: DataFrame) -> DataFrame:
    """Containment path by refs from the top. A pointer names all its
    ancestors, so the path needs one equi join instead of a walk: the prefixes
    of each pointer are joined to the elements they name. Both sides read the
    kept places, so the documents are read once."""
    c = components.filter(~F.col("role").isin("ancestor", "descendant", "variant"))
    c = kept(c.select("bom_id", "pointer", "bom_ref", "name"), "places")
    steps = F.split("pointer", "/components/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, 1, n + 1), "/components/")
    )
    pre = c.select("bom_id", "pointer", "bom_ref", F.posexplode(F.when(F.size(steps) > 1, prefixes).otherwise(F.array("pointer"))).alias("_n", "_at"))
    names = c.select("bom_id", F.col("pointer").alias("_at"), F.coalesce("bom_ref", "name").alias("_name"))
    return pre.join(names, ["bom_id", "_at"]).groupBy("bom_id", "pointer", "bom_ref").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_name"))), lambda x: x["_name"]), ">").alias("path"),
        (F.max("_n") + 1).alias("level"),
    )
