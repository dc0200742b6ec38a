import pytest
from pyspark.sql import functions as F

from bomspark.functions import scalars as S, sqlfuncs, udx


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "version,rng,want",
    [
        ("7.0.3", "vers:generic/>=1.0.0-beta1|<=1.7.5|>=7.0.0-M1|<=7.0.7|>=8.0.0-M1|<=8.0.1", True),
        ("1.7.6", "vers:generic/>=1.0.0-beta1|<=1.7.5|>=7.0.0-M1|<=7.0.7", False),
        ("7.0.0-M1", "vers:generic/>=7.0.0-M1|<=7.0.7", True),
        ("2.2.1", "vers:generic/>=2.2.0|!= 2.2.1|<2.3.0", False),
        ("2.2.2", "vers:generic/>=2.2.0|!= 2.2.1|<2.3.0", True),
        ("1.2.3", "vers:semver/1.2.3|>=2.0.0|<5.0.0", True),
        ("5.0.0", "vers:semver/1.2.3|>=2.0.0|<5.0.0", False),
        ("9", "vers:generic/*", True),
        ("0.1", "vers:generic/<1.0", True),
        ("3", "vers:generic/>1.0", True),
        ("1.0", "vers:npm/>=1.0", None),
        ("latest", "vers:generic/>=1.0", None),
    ],
)
def test_in_range(spark, version, rng, want):
    assert one(spark, S.in_range(F.lit(version), F.lit(rng))) is want


def test_version_order(spark):
    texts = ["1.0.0-alpha", "1.0.0-beta1", "1.0.0-beta2", "1.0", "1.0.0.1", "v1.2", "1.10", "2.0pre1", "2.0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = [r.v for r in df.orderBy(F.rand(1)).orderBy(S.version_key("v")).collect()]
    assert got == texts
    assert one(spark, S.version_key(F.lit("1.0")) == S.version_key(F.lit("1.0.0")))


def test_enum_spellings(spark):
    assert one(spark, S.enum_canonical(F.lit("HASH_ALG_SHA_3_256"), "hash_alg")) == "SHA3-256"
    assert one(spark, S.enum_canonical(F.lit("CLASSIFICATION_NULL"), "component_type")) is None
    assert one(spark, S.enum_canonical(F.lit("LIFECYCLE_PHASE_DESIGN"), "lifecycle_phase")) == "design"
    assert one(spark, S.enum_canonical(F.lit("SEVERITY_UNKNOWN"), "severity")) == "unknown"
    assert one(spark, S.enum_canonical(F.lit("TLP_CLASSIFICATION_AMBER_AND_STRICT"), "tlp")) == "AMBER_AND_STRICT"


def test_text_grammars(spark):
    p = one(spark, S.purl_parts(F.lit("pkg:npm/%40scope/b+c@1.0?x=y#s/t")))
    assert (p.type, p.namespace, p.name, p.version, p.qualifiers, p.subpath) == ("npm", "@scope", "b+c", "1.0", "x=y", "s/t")
    c = one(spark, S.cpe_parts(F.lit("cpe:2.3:a:ac\\:me:x:1:*:*:*:*:*:*:*")))
    assert (c.form, c.part, c.vendor, c.version) == ("2.3", "a", "ac\\:me", "1")
    assert one(spark, S.cpe_parts(F.lit("cpe:/o:v:p:2"))).vendor == "v"
    u = "3e671687-395b-41f5-a30f-a58921a69b79"
    link = one(spark, S.bom_link_make(F.lit("{" + u + "}"), F.lit(2), F.lit("a/b")))
    assert link == f"urn:cdx:{u}/2#a/b"
    parts = one(spark, S.bom_link_parts(F.lit(link)))
    assert (parts.uuid, parts.version, parts.ref) == (u, 2, "a/b")
    assert one(spark, S.bom_link_parts(F.lit(f"urn:cdx:{u}/0"))) is None
    assert one(spark, S.license_tokens(F.lit("(MIT OR LicenseRef-x) AND GPL-2.0-only WITH Classpath-exception-2.0"))) == [
        "MIT", "LicenseRef-x", "GPL-2.0-only", "Classpath-exception-2.0"]


def test_pointer_escapes(spark):
    v = F.parse_json(F.lit('{"a/b":{"~x":[10,20]}}'))
    assert one(spark, S.json_pointer_get(v, "/a~1b/~0x/1", "int")) == 20


def test_sql_functions_agree(spark):
    sqlfuncs.register_functions(spark)
    row = spark.sql("SELECT severity_rank('high') s, tlp_rank('RED') t, noisy_or(array(0.5D, 0.5D)) n, purl_without_version('pkg:a/b@1?x') p").first()
    assert (row.s, row.t, row.n, row.p) == (4, 4, 0.75, "pkg:a/b")
    assert one(spark, S.severity_rank(F.lit("high"))) == row.s


def test_scheme_order(spark):
    udx.register_scheme("len", lambda v: ([len(v)], []))
    key = udx.version_key_scheme("len")
    df = spark.createDataFrame([("aaa",), ("b",), (None,)], "v string")
    assert [r.v for r in df.filter("v is not null").orderBy(key("v")).collect()] == ["b", "aaa"]


def test_walk_document(spark):
    udx.register_table_functions(spark)
    rows = spark.sql("""SELECT * FROM walk_document('{"a":[1,"x"],"b/c":null}')""").collect()
    assert {(r.pointer, r.kind, r.value) for r in rows} == {
        ("", "object", None), ("/a", "array", None), ("/a/0", "scalar", "1"), ("/a/1", "scalar", "x"), ("/b~1c", "scalar", "null")}


def test_sql_names_agree_with_column_functions(spark):
    sqlfuncs.register_functions(spark)
    cases = {
        "purl_parts": (S.purl_parts, ["pkg:npm/%40ng/core@1.0?a=b#x/y", "pkg:gem/n", "no", None, "pkg:Deb/d/n@1+2"]),
        "cpe_parts": (S.cpe_parts, ["cpe:2.3:a:v:p\\:q:1:*:*:*:*:*:*:*", "cpe:/o:v:p:2", "x", None]),
        "bom_link_parts": (S.bom_link_parts, ["urn:cdx:5b1f1e0c-93d4-4d0e-8a52-6a1c0f7e2d90/2#r a", "urn:cdx:5b1f1e0c-93d4-4d0e-8a52-6a1c0f7e2d90/1", "urn:x", None]),
        "gitoid_parts": (S.gitoid_parts, ["gitoid:blob:sha1:ab", "gitoid:blob", "x", None]),
        "swhid_parts": (S.swhid_parts, ["swh:1:cnt:ab;origin=x", "swh:x", "y", None]),
        "vers_constraints": (S.vers_constraints, ["vers:npm/>=1.0|<2%2B", "vers:generic/*", "bad", None]),
    }
    for name, (fn, values) in cases.items():
        df = spark.createDataFrame([(v,) for v in values], "v string")
        for r in df.select(fn(F.col("v")).alias("a"), F.expr(f"{name}(v)").alias("b")).collect():
            assert r.a == r.b, name
    v = spark.createDataFrame([("SEVERITY_HIGH",), ("high",), ("",), (None,)], "v string")
    assert all(r.a == r.b for r in v.select(S.enum_canonical("v", "severity").alias("a"), F.expr("enum_canonical(v, 'severity')").alias("b")).collect())
