import json

from frames import doc_frame

from bomspark.operators import rules as R

OK = {"specVersion": "1.7", "serialNumber": "urn:uuid:5b1f1e0c-93d4-4d0e-8a52-6a1c0f7e2d90", "version": 1}
COMP = {"type": "library", "name": "n", "version": "1"}


def doc(component=None, **top):
    return json.dumps({**OK, "components": [{**COMP, **(component or {})}], **top})


# one broken rule per document
CASES = {
    "ok": (doc(), None),
    "dangling references are no error": (doc(dependencies=[{"ref": "x", "dependsOn": ["y"]}]), None),
    "short hash under another algorithm is a lint": (doc({"hashes": [{"alg": "SHA-256", "content": "0" * 32}]}), None),
    "repeated ref is not seen by this format": (doc({"bom-ref": "a", "components": [{**COMP, "bom-ref": "a"}]}), None),
    "broken text": ("{not json", "unreadable"),
    "type": (doc({"type": None}), "required"),
    "type value": (doc({"type": "thing"}), "enum"),
    "type too new": (json.dumps({"specVersion": "1.3", "version": 1, "components": [{**COMP, "type": "data"}]}), "enum"),
    "empty ref": (doc({"bom-ref": ""}), "length"),
    "hash alg": (doc({"hashes": [{"alg": "ROT13", "content": "0" * 32}]}), "enum"),
    "hash digits": (doc({"hashes": [{"alg": "MD5", "content": "abc"}]}), "pattern"),
    "serial": (doc(serialNumber="urn:uuid:nope"), "pattern"),
    "license both": (doc({"licenses": [{"license": {"id": "MIT", "name": "x"}}]}), "choice"),
    "license none": (doc({"licenses": [{"license": {}}]}), "choice"),
    "license list": (doc({"licenses": [{"license": {"id": "Apache-2"}}]}), "license_id"),
    "version and range": (doc({"versionRange": "vers:generic/*", "isExternal": True}), "version_range"),
    "range not external": (doc({"version": None, "versionRange": "vers:generic/*"}), "version_range"),
    "data on library": (doc({"data": [{"type": "dataset"}]}), "type_specific"),
    "date only": (doc(metadata={"timestamp": "2024-01-01"}), "timestamp"),
    "unknown key": (doc(metadata={"distribution": "x"}), "unknown_field"),
    "swid": (doc({"swid": {"name": "n"}}), "required"),
    "flow": (doc(services=[{"name": "s", "data": [{"classification": "c", "flow": "bar"}]}]), "enum"),
    "citation": (doc(citations=[{"pointers": ["/a"], "timestamp": "2024-01-01T00:00:00Z"}]), "citation_source"),
    "dependency ref": (doc(dependencies=[{"dependsOn": ["a"]}]), "required"),
    "property name": (doc(properties=[{"value": "v"}]), "required"),
    "issue type": (doc({"pedigree": {"patches": [{"type": "backport", "resolves": [{"type": "x"}]}]}}), "enum"),
    "version zero": (doc(version=0), "range"),
    "crypto level": (doc({"type": "cryptographic-asset", "cryptoProperties": {"assetType": "algorithm", "algorithmProperties": {"nistQuantumSecurityLevel": 7}}}), "range"),
    "marking": (doc(metadata={"distributionConstraints": {"tlp": "PINK"}}), "enum"),
    "rating method": (doc(vulnerabilities=[{"id": "V-1", "ratings": [{"method": "dice"}]}]), "enum"),
    "technique": (doc({"evidence": {"identity": [{"field": "name", "methods": [{"technique": "guess", "confidence": 0.5}]}]}}), "enum"),
    "equal entries in an old version": (json.dumps({"specVersion": "1.3", "version": 1, "components": [COMP, COMP]}), "unique_items"),
    "equal entries in a new version": (json.dumps({**OK, "components": [COMP, COMP]}), None),
}


def test_one_rule_per_document(spark):
    docs = doc_frame(spark, *[c[0] for c in CASES.values()])
    known = spark.createDataFrame([("MIT",), ("Apache-2.0",)], "license_id string")
    v = R.validate(docs, known)
    got = {int(r.bom_id): (r.valid, r.first_rule) for r in R.document_verdict(docs, v).collect()}
    for i, (name, (_, rule)) in enumerate(CASES.items()):
        assert got[i] == (rule is None, rule), name
    warn = {(int(r.bom_id), r.rule) for r in v.filter("severity = 'warning'").collect()}
    names = list(CASES)
    assert (names.index("dangling references are no error"), "ref_dangling") in warn
    assert (names.index("short hash under another algorithm is a lint"), "hash_length") in warn
    assert (names.index("repeated ref is not seen by this format"), "ref_unique") in warn


def test_expected_by_file_name(spark):
    docs = spark.createDataFrame([("a", "/c/valid-x.json"), ("b", "/c/invalid-y.json"), ("c", "/c/informal-invalid-z.xml")], "bom_id string, source_path string")
    verdicts = spark.createDataFrame([("a", False, "enum"), ("b", False, "enum"), ("c", True, None)], "bom_id string, valid boolean, first_rule string")
    assert [r.file for r in R.verdict_vs_expected(verdicts, docs).collect()] == ["valid-x.json"]
