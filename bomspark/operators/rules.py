"""The standard's rules as data-quality jobs.

A rule is a condition on a table. All row rules of a table run in one pass:
each row builds the list of rules it breaks and only those are exploded. Rules
over several rows (uniqueness, references) are joins or group-bys. Every rule
emits ``violation(bom_id, rule, severity, pointer, value)``; severity ``error``
makes a document invalid, ``warning`` does not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import scalars as S
from ..model import doc_schema as D, enums as en
from ..session import cut, kept

ERROR, WARNING = "error", "warning"
COLUMNS = ["bom_id", "rule", "severity", "pointer", "value"]


@dataclass(frozen=True)
class RowRule:
    name: str
    broken: Column
    value: Column
    severity: str = ERROR


def check_rows(df: DataFrame, rules: list[RowRule], pointer: Column | str = "pointer") -> DataFrame:
    """One scan for all row rules of a table."""
    p = F.col(pointer) if isinstance(pointer, str) else pointer
    hits = F.array(*[
        F.when(
            F.coalesce(r.broken, F.lit(False)),
            F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), r.value.cast("string").alias("value")),
        )
        for r in rules
    ])
    return df.select("bom_id", p.alias("pointer"), F.explode(F.array_compact(hits)).alias("h")).select(
        "bom_id", "h.rule", "h.severity", "pointer", "h.value"
    )


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.select(*COLUMNS).unionByName(b.select(*COLUMNS)), frames)


# ------------------------------------------------------------------ row rules

def required(*columns: str) -> list[RowRule]:
    return [RowRule("required", F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in columns]


def version_number(c: Column) -> Column:
    """A spec version as numbers, so that 1.10 is newer than 1.5."""
    return F.transform(F.split(c, r"\."), lambda x: x.try_cast("int"))


def enum(column: str, name: str, version: str | None = "spec_version") -> RowRule:
    """Value in its enum and, when a version column is given, old enough for it."""
    c = F.col(column)
    bad = ~c.isin(en.ENUMS[name][1])
    for value, since in en.VALUE_SINCE.get(name, {}).items() if version else ():
        bad = bad | ((c == value) & (version_number(F.col(version)) < version_number(F.lit(since))))
    return RowRule("enum", c.isNotNull() & bad, F.concat_ws("=", F.lit(column), c))


def pattern(column: str, name: str) -> RowRule:
    c = F.col(column)
    return RowRule("pattern", c.isNotNull() & ~c.rlike(en.anchored(name)), c)


def bounded(column: str, lo: float | None, hi: float | None) -> RowRule:
    c, bad = F.col(column), F.lit(False)
    if lo is not None:
        bad = bad | (c < lo)
    if hi is not None:
        bad = bad | (c > hi)
    return RowRule("range", bad, F.concat_ws("=", F.lit(column), c.cast("string")))


def length(column: str, lo: int, hi: int | None = None) -> RowRule:
    n = F.length(column)
    return RowRule("length", (n < lo) | (n > hi if hi is not None else F.lit(False)), F.lit(column))


def choice(name: str, *branches: Column, at_least: int = 1) -> RowRule:
    """Exactly one branch set (``at_least=0``: none is fine too)."""
    n = reduce(lambda a, b: a + b, [b.isNotNull().cast("int") for b in branches])
    return RowRule("choice", (n > 1) | (n < at_least), F.concat_ws("=", F.lit(name), n.cast("string")))


def version_range_rules() -> list[RowRule]:
    """On a component table: version xor range, a range needs an external
    component, the main component is not external."""
    v, r, e = F.col("version"), F.col("version_range"), F.coalesce("is_external", F.lit(False))
    return [
        RowRule("version_range", v.isNotNull() & r.isNotNull(), F.lit("version and versionRange")),
        RowRule("version_range", r.isNotNull() & ~e, F.lit("versionRange on a part that is not external")),
        RowRule("version_range", (F.col("role") == "main") & e, F.lit("main component is external")),
    ]


def type_specific_rules() -> list[RowRule]:
    """On component elements: sections that belong to one type only."""
    t = F.col("c.type")
    return [
        RowRule("type_specific", F.col("c.data").isNotNull() & (t != "data"), F.lit("data")),
        RowRule("type_specific", F.col("c.modelCard").isNotNull() & (t != "machine-learning-model"), F.lit("modelCard")),
    ]


def date_time(column: Column, name: str) -> RowRule:
    ok = column.rlike(en.anchored("date_time")) & F.try_to_timestamp(column).isNotNull()
    return RowRule("timestamp", column.isNotNull() & ~ok, F.concat_ws("=", F.lit(name), column))


def ref_link_prefix(column: str) -> RowRule:
    return RowRule("ref_link_prefix", F.col(column).startswith("urn:cdx:"), F.col(column), WARNING)


def vex_rules() -> list[RowRule]:
    s = F.col("state")
    return [
        RowRule("vex_justification", (s == "not_affected") & F.col("justification").isNull(), s, WARNING),
        RowRule("vex_justification", (s == "exploitable") & (F.coalesce(F.size("response"), F.lit(0)) < 1), s, WARNING),
    ]


def hash_length(alg: str = "alg", value: str = "value") -> RowRule:
    """Number of digits against the algorithm: a lint, not part of the verdict.
    The algorithm table has a fixed size, so it is a literal map."""
    digits = F.create_map(*[F.lit(x) for kv in en.HASH_DIGITS.items() for x in kv])
    want = F.try_element_at(digits, F.col(alg))
    return RowRule("hash_length", want.isNotNull() & (F.length(value) != want), F.concat_ws(":", alg, F.length(value)), WARNING)


def date_order(first: str, second: str) -> RowRule:
    return RowRule("date_order", F.col(first) > F.col(second), F.lit(f"{first} > {second}"), WARNING)


def deprecated(*fields: Column, names: list[str]) -> list[RowRule]:
    return [RowRule("deprecated", f.isNotNull(), F.lit(n), WARNING) for f, n in zip(fields, names, strict=True)]


# ------------------------------------------------------------------ rules over rows

def license_ids(license_uses: DataFrame, known: DataFrame) -> DataFrame:
    """``license_uses(bom_id, pointer, license_id)`` with ids outside the list."""
    ids = known.select("license_id").distinct()
    bad = license_uses.filter("license_id IS NOT NULL").join(ids, "license_id", "left_anti")
    return _emit(bad, "license_id", ERROR, F.col("pointer"), F.col("license_id"))


def _emit(df: DataFrame, rule: str, severity: str, pointer: Column, value: Column) -> DataFrame:
    return df.select("bom_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), pointer.alias("pointer"), value.cast("string").alias("value"))


def ref_unique(refs: DataFrame, severity: str = ERROR) -> DataFrame:
    """Refs declared more than once in a document."""
    twice = refs.groupBy("bom_id", "ref").agg(F.count("*").alias("_n"), F.min("pointer").alias("pointer")).filter("_n > 1")
    return _emit(twice, "ref_unique", severity, F.col("pointer"), F.col("ref"))


def ref_dangling(uses: DataFrame, refs: DataFrame) -> DataFrame:
    """References without a target in the document. Links to other documents
    are not in-document references."""
    local = uses.filter(~F.col("target").startswith("urn:cdx:"))
    lost = local.join(refs.select("bom_id", F.col("ref").alias("target")).distinct(), ["bom_id", "target"], "left_anti")
    return _emit(lost, "ref_dangling", WARNING, F.col("field"), F.col("target"))


def serial_unique(boms: DataFrame) -> DataFrame:
    """Same (serial, version) on different content. Contents are told apart
    first, so one group holds each content once."""
    contents = boms.filter("serial_number IS NOT NULL").groupBy("serial_number", "version", "content_hash").agg(F.min("bom_id").alias("bom_id"))
    bad = contents.groupBy("serial_number", "version").agg(F.count("*").alias("_n"), F.min("bom_id").alias("bom_id")).filter("_n > 1")
    return _emit(bad, "serial_unique", ERROR, F.lit("/serialNumber"), F.concat_ws("/", "serial_number", "version"))


def requirement_parent(requirements: DataFrame) -> DataFrame:
    """Parents named by requirements but not declared in the same document."""
    lost = requirements.filter("parent IS NOT NULL").join(
        requirements.select("bom_id", F.col("bom_ref").alias("parent")).distinct(), ["bom_id", "parent"], "left_anti"
    )
    return _emit(lost, "requirement_parent", ERROR, F.col("bom_ref"), F.col("parent"))


def citation_source(docs: DataFrame) -> DataFrame:
    """A citation names who or what it rests on, exactly one kind of target,
    and a list that is given is not empty."""
    c = docs.select("bom_id", F.posexplode("doc.citations").alias("_i", "c"))
    p, e = F.col("c.pointers"), F.col("c.expressions")
    return check_rows(
        c,
        [
            RowRule("citation_source", F.col("c.attributedTo").isNull() & F.col("c.process").isNull(), F.lit("no source")),
            RowRule("choice", p.isNotNull() & e.isNotNull(), F.lit("pointers and expressions")),
            RowRule("choice", p.isNull() & e.isNull(), F.lit("no target")),
            RowRule("citation_source", (F.size(p) == 0) | (F.size(e) == 0), F.lit("empty list")),
        ],
        F.concat(F.lit("/citations/"), F.col("_i").cast("string")),
    )


def unique_items(elements: DataFrame, versions: DataFrame, since: str = "1.5") -> DataFrame:
    """Equal entries of one list of components or services, an error in
    documents older than ``since``. Entries are told apart by a digest."""
    rows = elements.join(versions, "bom_id").filter(version_number(F.col("spec_version")) < version_number(F.lit(since)))
    rows = rows.filter(F.col("pointer").rlike("/[0-9]+$")).select(
        "bom_id", "pointer", F.regexp_replace("pointer", "/[0-9]+$", "").alias("list"), F.sha2(F.to_json("c"), 256).alias("content")
    )
    again = rows.groupBy("bom_id", "list", "content").agg(F.count("*").alias("_n"), F.max("pointer").alias("pointer")).filter("_n > 1")
    return _emit(again, "unique_items", ERROR, F.col("pointer"), F.col("list"))


def crypto_rules(components: DataFrame) -> DataFrame:
    """Bounds of security levels and order of certificate dates."""
    k = F.when(F.col("c.cryptoProperties").isNotNull(), F.try_variant_get(F.col("c.cryptoProperties"), "$", D.CRYPTO))
    al, ce = F.col("_k.algorithmProperties"), F.col("_k.certificateProperties")
    rows = components.withColumn("_k", k).filter("_k IS NOT NULL").select(
        "bom_id", "pointer", al["nistQuantumSecurityLevel"].alias("nistQuantumSecurityLevel"), al["classicalSecurityLevel"].alias("classicalSecurityLevel"),
        F.try_to_timestamp(ce["notValidBefore"]).alias("notValidBefore"), F.try_to_timestamp(ce["notValidAfter"]).alias("notValidAfter"),
    )
    return check_rows(rows, [bounded("nistQuantumSecurityLevel", 0, 6), bounded("classicalSecurityLevel", 0, None), date_order("notValidBefore", "notValidAfter")])


def _names(ddl: str) -> list[str]:
    got = T._parse_datatype_string(ddl)
    return got.fieldNames()


def known_members(element: str) -> list[str]:
    shapes = {"document": D.DOCUMENT, "metadata": D.METADATA, "component": D.COMPONENT, "service": D.SERVICE}
    return [*_names(shapes[element]), "signature"]


def _doubtful(element: str, members: Column) -> Column:
    """Members that no version knows, or only newer ones."""
    known, since = (F.array(*[F.lit(n) for n in names]) for names in (known_members(element), en.MEMBER_SINCE[element]))
    return F.array_union(F.array_except(members, known), F.array_intersect(members, since))


def _unknown(df: DataFrame, element: str, members: Column, pointer: Column) -> DataFrame:
    known = F.array(*[F.lit(n) for n in known_members(element)])
    strange = F.array_except(members, known)
    early = F.array(*[
        F.when(F.array_contains(members, n) & (version_number(F.col("spec_version")) < version_number(F.lit(v))), F.lit(n)) for n, v in en.MEMBER_SINCE[element].items()
    ])
    bad = df.select("bom_id", pointer.alias("pointer"), F.explode(F.array_union(strange, F.array_compact(early))).alias("key"))
    return _emit(bad, "unknown_field", ERROR, F.col("pointer"), F.concat(F.lit(f"{element}."), F.col("key")))


def unknown_fields(docs: DataFrame, components: DataFrame | None = None, services: DataFrame | None = None) -> DataFrame:
    """Members an element does not have in the version of its document.
    Element frames are made ``with_members``. Documents are read once, for their
    versions and doubtful members, which are kept; what is joined to the
    versions are doubtful members, not elements."""
    top = docs.select("bom_id", F.col("doc.specVersion").alias("spec_version"), F.try_parse_json("content").alias("_v"))
    keys = lambda path: F.map_keys(F.try_variant_get("_v", path, "map<string, variant>"))
    d = kept(top.select("bom_id", "spec_version", _doubtful("document", keys("$")).alias("_d"), _doubtful("metadata", keys("$.metadata")).alias("_m")), "members")
    out = [_unknown(d, "document", F.col("_d"), F.lit("")), _unknown(d, "metadata", F.col("_m"), F.lit("/metadata"))]
    version = d.select("bom_id", "spec_version")
    for frame, name in ((components, "component"), (services, "service")):
        if frame is not None:
            found = frame.select("bom_id", "pointer", _doubtful(name, F.col("members")).alias("members"))
            out.append(_unknown(found.join(version, "bom_id"), name, F.col("members"), F.col("pointer")))
    return union(out)


def deprecated_fields(docs: DataFrame, components: DataFrame) -> DataFrame:
    """Use of members that newer versions replace."""
    m, c = F.col("doc.metadata"), F.col("c")
    k = F.when(c["cryptoProperties"].isNotNull(), F.try_variant_get(c["cryptoProperties"], "$", D.CRYPTO))
    legacy_tools = F.try_variant_get(m["tools"], "$", "array<variant>")
    on_docs = check_rows(docs, deprecated(m["manufacture"], legacy_tools, names=["metadata.manufacture", "metadata.tools[]"]), F.lit("/metadata"))
    comp = components.withColumn("_k", k)
    ce, ma, al = F.col("_k.certificateProperties"), F.col("_k.relatedCryptoMaterialProperties"), F.col("_k.algorithmProperties")
    on_components = check_rows(
        comp,
        deprecated(
            c["author"], al["curve"], ce["signatureAlgorithmRef"], ce["subjectPublicKeyRef"], ce["certificateExtension"], ma["algorithmRef"],
            names=["component.author", "curve", "signatureAlgorithmRef", "subjectPublicKeyRef", "certificateExtension", "algorithmRef"],
        ),
    )
    return union([on_docs, on_components])


# ------------------------------------------------------------------ verdicts

def document_verdict(docs: DataFrame, violations: DataFrame) -> DataFrame:
    """valid / invalid per document and the first rule it breaks."""
    worst = violations.filter(F.col("severity") == ERROR).groupBy("bom_id").agg(
        F.count("*").alias("n_errors"), F.min_by("rule", F.struct("pointer", "rule", "value")).alias("first_rule")
    )
    return docs.select("bom_id").distinct().join(worst, "bom_id", "left").select(
        "bom_id", F.col("n_errors").isNull().alias("valid"), F.coalesce("n_errors", F.lit(0)).alias("n_errors"), "first_rule"
    )


def verdict_vs_expected(verdicts: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents whose file name promises another verdict. Other prefixes than
    ``valid-`` and ``invalid-`` promise nothing."""
    name = F.regexp_extract("source_path", r"([^/]+)$", 1)
    want = F.when(name.startswith("valid-"), True).when(name.startswith("invalid-"), False)
    d = docs.select("bom_id", name.alias("file"), want.alias("expected")).filter("expected IS NOT NULL")
    return d.join(verdicts, "bom_id").filter("expected <> valid").select("bom_id", "file", "expected", "valid", "first_rule")


@dataclass
class RuleSet:
    """User rules next to the built-in ones."""

    rules: list[tuple[str, str, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)

    def rule(self, name: str, severity: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        """``fn`` takes a table and returns the offending rows with ``bom_id, pointer, value``."""
        self.rules.append((name, severity, fn))

    def run(self, table: DataFrame) -> DataFrame:
        return union([_emit(fn(table), n, s, F.col("pointer"), F.col("value")) for n, s, fn in self.rules])


def validate(docs: DataFrame, known_licenses: DataFrame | None = None, bom_format: str | None = None) -> DataFrame:
    """All rules on parsed JSON documents. ``bom_format`` is the text the
    ``bomFormat`` member has to hold, if it is to be checked."""
    from . import flatten as X, shape_rules as V, shred as H

    good = F.col("doc").isNotNull() & F.try_parse_json("content").isNotNull() & F.ltrim("content").startswith("{")
    unreadable = _emit(docs.filter(~good), "unreadable", ERROR, F.lit(""), F.lit(None).cast("string"))
    # the typed view is parsed once and shared by all rules
    docs = cut(docs.filter(good).select("bom_id", "content", "doc"))
    ver = docs.select("bom_id", F.col("doc.specVersion").alias("spec_version"))
    # the elements feed many branches, so they are kept as well
    comp, serv = cut(X.component_elements(docs)), cut(X.service_elements(docs))
    # one walk for references, their uses, properties and the rules over values
    objs = cut(H.objects(docs, H.merged(V.wanted(), H.wanted_refs(), H.wanted_uses(), H.WANTED_PROPERTIES)))
    table = X.flatten_components(comp).join(ver, "bom_id")
    d = F.col("doc")
    boms = docs.select(
        "bom_id", d["specVersion"].alias("specVersion"), d["serialNumber"].alias("serialNumber"), d["bomFormat"].alias("bomFormat"),
        d["version"].try_cast("int").alias("version"), d["metadata"]["timestamp"].alias("timestamp"), d["version"].alias("version_text"),
        d["metadata"]["distributionConstraints"]["tlp"].alias("tlp"),
    )
    top = [*required("specVersion"), pattern("serialNumber", "serial"), bounded("version", 1, None), date_time(F.col("timestamp"), "timestamp"), enum("tlp", "tlp", None),
           RowRule("range", F.col("version_text").isNotNull() & F.col("version").isNull(), F.lit("version"))]
    if bom_format is not None:
        top.append(RowRule("enum", ~F.col("bomFormat").eqNullSafe(bom_format), F.lit("bomFormat")))
    raw = comp.select("bom_id", "pointer", "c", F.col("c")["bom-ref"].alias("ref"), F.col("c.version").alias("version"), F.col("c.versionRange").alias("version_range"),
                      F.col("c.cpe").alias("cpe"), F.col("c")["mime-type"].alias("media_type"), F.col("c.scope").alias("scope"),
                      F.col("c.swid").alias("swid"), F.col("c.swid.tagId").alias("tag_id"), F.col("c.swid.name").alias("swid_name"), F.col("c.name").alias("name"),
                      F.col("c.type").alias("type"), F.col("c.isExternal").alias("is_external"), "role").join(ver, "bom_id")
    swid = F.col("swid").isNotNull()
    comp_rules = [
        *required("type", "name"), enum("type", "component_type"), enum("scope", "scope"), pattern("cpe", "cpe"), pattern("media_type", "media_type"),
        length("version", 0, 1024), length("version_range", 1, 4096), length("ref", 1), ref_link_prefix("ref"), *version_range_rules(), *type_specific_rules(),
        RowRule("required", swid & F.col("tag_id").isNull(), F.lit("tagId")), RowRule("required", swid & F.col("swid_name").isNull(), F.lit("swid name")),
    ]
    hashes = X.explode_hashes(comp).join(ver, "bom_id").withColumnRenamed("owner_pointer", "pointer")
    lic_raw = _license_choices(docs, comp, serv)
    dep = docs.select("bom_id", F.posexplode("doc.dependencies").alias("_i", "n")).select("bom_id", F.concat(F.lit("/dependencies/"), F.col("_i").cast("string")).alias("pointer"), F.col("n.ref").alias("ref"))
    refs_ext = X.explode_external_references(docs, comp, serv).join(ver, "bom_id").withColumnRenamed("owner_pointer", "pointer")
    props = H.properties_of(objs).withColumnRenamed("owner_pointer", "pointer")
    patches = X.pedigree_patches(comp).withColumnRenamed("owner_pointer", "pointer")
    issues = X.pedigree_issues(X.pedigree_patches(comp)).withColumnRenamed("owner_pointer", "pointer")
    flows = X.explode_data_flows(serv).withColumnRenamed("owner_pointer", "pointer").withColumnRenamed("direction", "flow").join(ver, "bom_id")
    services = X.flatten_services(serv)
    vul = X.explode_vulnerabilities(docs)
    at = lambda p: F.concat(F.lit(p), F.col("position").cast("string"))
    refs = H.refs_of(objs)
    notes = X.release_note_texts(X.release_notes(comp))
    ident = X.evidence_identity(comp).withColumnRenamed("owner_pointer", "pointer")
    decl = X.explode_declarations(docs)["attestation_map"]
    std = X.explode_standards(docs)["requirement"]
    life = X.lifecycle_table(docs)
    ann = docs.select("bom_id", F.posexplode("doc.annotations").alias("position", "a"))
    frames = [
        unreadable, check_rows(boms, top, F.lit("")), check_rows(raw, comp_rules),
        check_rows(hashes, [*required("alg", "value"), enum("alg", "hash_alg"), pattern("value", "hash"), hash_length()]),
        check_rows(lic_raw, [
            RowRule("choice", F.col("lic").isNotNull() & (F.col("id").isNotNull().cast("int") + F.col("lname").isNotNull().cast("int") != 1), F.lit("license id/name")),
            RowRule("choice", F.col("lic").isNotNull() & F.col("expression").isNotNull(), F.lit("license/expression")),
        ]),
        check_rows(dep, [*required("ref")]), check_rows(refs_ext, [*required("type", "url"), enum("type", "reference_type")]),
        check_rows(props, [RowRule("required", F.col("name").isNull(), F.lit("property name"))]),
        check_rows(patches, [*required("type"), enum("type", "patch_type", None)]), check_rows(issues, [*required("type"), enum("type", "issue_type", None)]),
        check_rows(flows, [*required("flow", "classification"), enum("flow", "data_flow", None)]), check_rows(services, [*required("name")]),
        check_rows(vul["rating"], [enum("severity", "severity", None), enum("method", "score_method", None)], at("/vulnerabilities/")),
        check_rows(vul["analysis"], [enum("state", "analysis_state", None), enum("justification", "justification", None), *vex_rules()], at("/vulnerabilities/")),
        check_rows(vul["affects"], [choice("affected version", F.col("version"), F.col("vers_range"), at_least=0)], at("/vulnerabilities/")),
        check_rows(notes, [pattern("locale", "locale")], "owner_pointer"),
        check_rows(ident, [bounded("confidence", 0, 1), enum("field", "evidence_field", None)]),
        check_rows(decl, [bounded("conformance_score", 0, 1), bounded("confidence_score", 0, 1)], at("/declarations/attestations/map/")),
        check_rows(std.withColumn("cre", F.explode_outer("open_cre")), [pattern("cre", "cre")], "bom_ref"),
        check_rows(life, [choice("lifecycle", F.col("phase"), F.col("name")), enum("phase", "lifecycle_phase", None)], at("/metadata/lifecycles/")),
        check_rows(ann, [choice("annotator", *[F.col("a.annotator")[k] for k in ("organization", "individual", "component", "service")])], at("/annotations/")),
        citation_source(docs), requirement_parent(std), ref_unique(refs, WARNING), ref_dangling(H.uses_of(objs), refs),
        V.check_objects(objs), deprecated_fields(docs, comp), crypto_rules(comp), unique_items(comp, ver), unique_items(serv, ver),
        check_rows(X.evidence_methods(X.evidence_identity(comp)).withColumnRenamed("owner_pointer", "pointer"), [bounded("confidence", 0, 1), enum("technique", "technique", None)]),
    ]
    if known_licenses is not None:
        frames.append(license_ids(lic_raw.select("bom_id", "pointer", F.col("id").alias("license_id")), known_licenses))
    # planning cost grows faster than the number of branches, so the branches are materialized in small groups
    return union([cut(union(frames[i : i + 4])) for i in range(0, len(frames), 4)])


def _license_choices(docs: DataFrame, comp: DataFrame, serv: DataFrame) -> DataFrame:
    rows = lambda df, c, p: df.select("bom_id", p.alias("pointer"), F.explode(c).alias("l"))
    every = (
        rows(docs, F.col("doc.metadata.licenses"), F.lit("/metadata/licenses"))
        .unionByName(rows(comp, F.col("c.licenses"), F.col("pointer"))).unionByName(rows(serv, F.col("c.licenses"), F.col("pointer")))
    )
    return every.select(
        "bom_id", "pointer", F.col("l.license").alias("lic"), F.col("l.license.id").alias("id"), F.col("l.license.name").alias("lname"),
        F.col("l.expression").alias("expression"),
    )
