"""Document corpora that Spark derives from the driver's tables, so that the
document operators run over data that grows with the tables and the check can
state the expected rows as SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.documents import json_array, typed

lit, col = F.lit, F.col


def S(**kw) -> Column:
    """Struct with JSON member names; ``bom_ref`` stands for ``bom-ref``,
    ``x_trust_boundary`` for its hyphenated name, a trailing ``_`` is dropped."""
    names = {"bom_ref": "bom-ref", "x_trust_boundary": "x-trust-boundary"}
    return F.struct(*[v.alias(names.get(k, k.rstrip("_"))) for k, v in kw.items()])


def js(**kw) -> Column:
    return F.to_json(S(**kw))


def cat(*parts) -> Column:
    return F.concat(*[lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def items(df: DataFrame, key: Column, grp, order: Column, item: Column) -> DataFrame:
    return df.select(key.alias("bom_id"), (lit(grp) if isinstance(grp, str) else grp).alias("grp"), order.cast("string").alias("ord"), item.alias("item"))


def gather(rows: DataFrame, groups: list[str]) -> DataFrame:
    """One row per document with an ordered list of JSON texts per group. A
    document is one text, so its elements do meet in one row."""

    def one(g: str) -> Column:
        lst = F.array_sort(F.collect_list(F.when(col("grp") == g, F.struct("ord", "item"))))
        return F.transform(lst, lambda x: x["item"]).alias(g)

    return rows.groupBy("bom_id").agg(*[one(g) for g in groups])


def gather_rows(df: DataFrame, key: str, kind: str, names: list[str]) -> DataFrame:
    """One row per document with a list of its plain rows. What groups and sorts
    holds the rows, not the texts made of them, which are far longer."""
    return df.groupBy(col(key).alias("bom_id")).agg(F.collect_list(F.struct(*names)).alias(kind))


def texts(rows: Column, order, item) -> Column:
    """Ordered list of JSON texts of the rows that a document has gathered."""
    made = F.transform(rows, lambda r: F.struct(order(r).cast("string").alias("ord"), item(r).alias("item")))
    return F.transform(F.array_sort(made), lambda x: x["item"])


def finish(df: DataFrame, *members: tuple[str, Column]) -> DataFrame:
    """Document text from members given as JSON text; null members are left out."""
    body = F.concat_ws(",", lit('"specVersion":"1.7","version":1'), *[F.concat(lit(f'"{n}":'), v) for n, v in members])
    docs = df.withColumn("content", F.concat(lit("{"), body, lit("}")))
    return typed(docs.select("bom_id", "content"))


def arr(name: str) -> Column:
    return F.when(F.size(name) > 0, json_array(col(name)))


def component_item(**more) -> Column:
    pid, sid = col("package_id"), col("supplier_id")
    return js(
        type=col("type"), bom_ref=col("bom_ref"), supplier=S(name=cat("S-", sid), address=S(country=cat("C-", sid % 25))),
        publisher=F.when(pid % 4 == 0, cat("P-", pid % 7)), group=col("comp_group"), name=col("name"), version=col("version"),
        isExternal=F.when(col("is_external"), lit(True)), scope=col("scope"),
        hashes=F.array(S(alg=lit("MD5"), content=col("hash_md5"))),
        licenses=F.array(S(
            license=F.when(pid % 3 != 0, S(
                id=F.when(pid % 3 == 1, col("license_id")), name=F.when(pid % 3 == 2, cat("Named ", col("license_id"))), acknowledgement=lit("declared"),
                licensing=F.when(pid % 6 == 1, S(
                    licensee=S(organization=S(name=cat("S-", sid))), purchaser=S(individual=S(name=cat("buyer-", pid % 11))),
                    purchaseOrder=cat("PO-", pid), licenseTypes=F.array(lit("perpetual"), lit("oem")), expiration=iso(col("released_at")),
                )),
            )),
            expression=F.when(pid % 3 == 0, cat("MIT OR ", col("license_id"))),
        )),
        purl=col("purl"), cpe=F.when(pid % 5 == 0, cat("cpe:2.3:a:acme:p", pid, ":1.0:*:*:*:*:*:*:*")),
        omniborId=F.when(pid % 7 == 0, F.array(cat("gitoid:blob:sha1:", pid), cat("gitoid:blob:sha256:", pid))),
        swid=F.when(pid % 10 == 0, S(tagId=cat("tag-", pid), name=col("name"))),
        externalReferences=F.array(S(type=lit("website"), url=cat("https://h", pid % 13, ".example/", pid)), S(type=lit("vcs"), url=cat("git://v/", sid))),
        properties=F.array(S(name=lit("tier"), value=(sid % 3).cast("string")), S(name=lit("tier"), value=lit("x")), S(name=lit("lot"), value=pid.cast("string"))),
        **more,
    )


def component_docs(t, deps: bool = False, comps: bool = False) -> DataFrame:
    """One document per order; lines 1-3 at the top, 4-5 in bundle ``b-1``, the
    rest in ``b-2`` inside it."""
    c, line = t.component_by_document, F.substring("bom_ref", 3, 9).cast("int")
    grp = F.when(line <= 3, "top").when(line <= 5, "mid").otherwise("deep")
    order = F.concat_ws("/", "bom_ref", "package_id", "supplier_id", "released_at")
    rows = items(c, col("bom_id"), grp, order, component_item())
    groups = ["top", "mid", "deep"]
    if deps:
        e = t.doc_edge_by_document
        provides = F.when(col("ref") == "c-1", F.array(lit("std-1")))
        on = F.when(col("ref") != "c-7", F.array("target"))
        rows = rows.unionByName(items(e, col("bom_id"), "dep", col("ref"), js(ref=col("ref"), dependsOn=on, provides=provides)))
        groups.append("dep")
    if comps:
        agg = F.when(col("scope") == "required", "complete").when(col("scope") == "optional", "incomplete")
        rows = rows.unionByName(items(c, col("bom_id"), "comp", order, js(aggregate=agg, assemblies=F.array("bom_ref"), dependencies=F.array(lit("main")))))
        groups.append("comp")
    g = gather(rows, groups)
    b = t.bom.join(g, "bom_id", "left")
    for n in groups:
        b = b.withColumn(n, F.coalesce(n, F.array().cast("array<string>")))

    def bundle(ref: str, inner: Column) -> Column:
        return F.when(F.size(inner) > 0, F.concat(lit(f'{{"type":"container","bom-ref":"{ref}","name":"bundle","components":'), json_array(inner), lit("}")))

    b = b.withColumn("mid", F.array_compact(F.concat("mid", F.array(bundle("b-2", col("deep"))))))
    b = b.withColumn("top", F.array_compact(F.concat("top", F.array(bundle("b-1", col("mid"))))))
    meta = js(
        timestamp=iso(col("created_at")), lifecycles=F.array(S(phase=col("lifecycle_phase"))),
        component=S(type=lit("application"), bom_ref=lit("main"), name=cat("app-", col("bom_id"))),
        supplier=S(name=cat("M-", col("bom_id") % 9)), distributionConstraints=F.when(col("tlp") != "CLEAR", S(tlp=col("tlp"))),
    )
    head = F.concat(
        lit('{"specVersion":"'), "spec_version", lit('","serialNumber":"'), "serial_number", lit('","version":'), col("version").cast("string"),
        lit(',"metadata":'), meta,
    )
    tail = [F.concat(lit('"components":'), json_array(col("top")))]
    if deps:
        tail.append(F.concat(lit('"dependencies":'), arr("dep")))
    if comps:
        tail.append(F.concat(lit('"compositions":'), arr("comp")))
    content = F.concat(head, lit(","), F.concat_ws(",", *tail), lit("}"))
    return typed(b.select("bom_id", content.alias("content")))


def vulnerability_docs(t) -> DataFrame:
    """Ten vulnerabilities per document."""
    k, p = col("vuln_key"), col("package_id")
    v = js(
        bom_ref=cat("v-", k), id=col("id"), source=S(name=col("source_name")), references=F.array(S(id=cat("ALT-", k), source=S(name=lit("alt")))),
        ratings=F.array(S(source=S(name=col("source_name")), score=col("score"), severity=col("severity"), method=lit("CVSSv31")),
                        S(source=S(name=lit("alt")), score=lit(None).cast("double"), severity=col("severity"), method=lit("other"))),
        cwes=F.array(col("cwe"), col("cwe") + 1), advisories=F.array(S(title=cat("A", k), url=cat("https://adv.example/", k))),
        published=iso(col("published_at")),
        credits=F.when(k % 2 == 0, S(individuals=F.array(S(name=cat("finder-", k % 17))))),
        analysis=S(state=col("analysis_state"), justification=F.when((col("analysis_state") == "not_affected") & (k % 4 == 1), "code_not_present"),
                   response=F.when(k % 3 == 2, F.array(lit("update"), lit("rollback"))), lastUpdated=iso(col("published_at"))),
        affects=F.array(S(ref=cat("pkg-", p), versions=F.array(
            S(version=lit(None).cast("string"), range_=col("vers_range"), status=lit(None).cast("string")),
            S(version=cat(p % 9, ".0.0"), range_=lit(None).cast("string"), status=lit("unaffected")),
        ))),
        properties=F.array(S(name=lit("Foo"), value=lit("1")), S(name=lit("Foo"), value=k.cast("string"))),
    )
    g = gather(items(t.vulnerability, F.floor(k / 10).cast("bigint"), "vul", F.lpad(k.cast("string"), 12, "0"), v), ["vul"])
    return finish(g, ("vulnerabilities", arr("vul")))


def service_docs(t) -> DataFrame:
    """Eight services per document, customer n+4 inside customer n."""
    k, seg = col("c_custkey"), col("c_mktsegment")
    c = t.raw("customer")
    flow = F.element_at(F.array(*[lit(x) for x in ("inbound", "outbound", "bi-directional", "unknown")]), (k % 4 + 1).cast("int"))

    def svc(key: Column, segment: Column, inner: Column | None) -> Column:
        nxt = key + 1
        kw = dict(
            bom_ref=cat("s-", key), provider=S(name=cat("Prov-", key % 5)), name=cat("svc-", key), endpoints=F.array(cat("https://e/", key)),
            authenticated=key % 2 == 0, x_trust_boundary=key % 3 == 0, trustZone=F.lower(segment),
            data=F.array(S(flow=flow, classification=segment, name=cat("d-", key), source=F.array(cat("s-", key)), destination=F.array(cat("s-", nxt), cat("x-", key)))),
        )
        if inner is not None:
            kw["services"] = inner
        return S(**kw)

    # the inner service is customer n+4 of the same block, found by an exact key
    kid = c.select((k - 4).alias("_up"), svc(k, seg, None).alias("_kid")).filter(F.pmod(col("_up"), lit(8)) < 4)
    top = c.filter(k % 8 < 4).join(kid, k == col("_up"), "left")
    doc = F.to_json(svc(k, seg, F.when(col("_kid").isNotNull(), F.array("_kid"))))
    g = gather(items(top, F.floor(k / 8).cast("bigint"), "svc", F.lpad(k.cast("string"), 12, "0"), doc), ["svc"])
    return finish(g, ("services", arr("svc")))


def annotation_docs(t) -> DataFrame:
    c = t.raw("conversations")
    name = cat("a-", col("conv_id"))
    user = col("role") == "user"
    a = js(
        subjects=F.array(cat("c-", col("turn")), lit("main")),
        annotator=S(individual=F.when(user, S(name=name)), component=F.when(~user, S(type=lit("application"), bom_ref=cat("tool-", col("turn")), name=lit("bot")))),
        timestamp=lit("2024-05-01T00:00:00Z"), text=col("text"),
    )
    g = gather(items(c, col("conv_id"), "ann", F.lpad(col("turn").cast("string"), 9, "0"), a), ["ann"])
    comps = js(type=lit("application"), bom_ref=lit("c-0"), name=lit("zero"))
    return finish(g, ("components", json_array(F.array(comps))), ("annotations", arr("ann")))


def formulation_docs(t) -> DataFrame:
    """One workflow per order, one task per line."""
    li = t.line_by_document
    n, q = col("l_linenumber"), col("l_quantity").cast("int")
    types = F.array(*[lit(x) for x in ("copy", "clone", "lint", "scan", "merge", "build", "test")])
    task = js(
        bom_ref=cat("t-", n), uid=cat(col("l_partkey"), "-", col("l_suppkey")), name=cat("task ", n), taskTypes=F.array(F.element_at(types, n)),
        timeStart=iso(col("l_shipdate")), timeEnd=iso(col("l_shipdate") + F.make_dt_interval(hours=q)),
        steps=F.array(S(name=lit("s1"), commands=F.array(S(executed=cat("make ", n)), S(executed=lit("true"))))),
        inputs=F.array(S(resource=S(ref=cat("in-", col("l_partkey"))))), outputs=F.array(S(type=lit("artifact"), resource=S(ref=cat("out-", col("l_partkey"))))),
        workspaces=F.when(n == 1, F.array(S(bom_ref=lit("w-1"), uid=lit("w1"), accessMode=lit("read-write"), volume=S(uid=lit("v1"), mode=lit("block"), sizeAllocated=cat(q, "GB"))))),
        trigger=F.when(n == 7, S(bom_ref=lit("g-1"), uid=lit("g1"), type=lit("api"), timeActivated=iso(col("l_shipdate")), event=S(uid=cat("e-", q)), conditions=F.array(S(expression=cat("q>", q))))),
    )
    order = F.concat_ws("/", n, "l_partkey", "l_suppkey", "l_shipdate", q)
    rows = items(li, col("l_orderkey"), "task", order, task)
    e = t.doc_edge_by_document.select("bom_id", F.regexp_replace("ref", "c-", "t-").alias("r"), F.regexp_replace("target", "c-", "t-").alias("tt"))
    rows = rows.unionByName(items(e, col("bom_id"), "edge", col("r"), js(ref=col("r"), dependsOn=F.array("tt"))))
    g = gather(rows, ["task", "edge"])
    wf = F.concat(
        lit('[{"bom-ref":"f-1","workflows":[{"bom-ref":"wf-1","uid":"wf","taskTypes":["build"],"tasks":'), F.coalesce(arr("task"), lit("[]")),
        lit(',"taskDependencies":'), F.coalesce(arr("edge"), lit("[]")), lit("}]}]"),
    )
    return finish(g, ("formulation", wf))


def declaration_docs(t) -> DataFrame:
    """One attestation per order; a map entry and a claim per line."""
    used = ["l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax"]
    g = gather_rows(t.line_by_document, "l_orderkey", "line", [*used, "l_returnflag"])

    def order(r: Column) -> Column:
        return F.concat_ws("/", *[r[n] for n in used])

    def entry(r: Column) -> Column:
        counter, claim = r["l_returnflag"] == "R", F.array(cat("k-", r["l_linenumber"]))
        return js(
            requirement=cat("r-", r["l_partkey"]), claims=F.when(~counter, claim), counterClaims=F.when(counter, claim),
            conformance=S(score=r["l_discount"] * 10), confidence=S(score=r["l_tax"] * 10),
        )

    def claim(n: Column) -> Column:
        return js(bom_ref=cat("k-", n), target=lit("main"), predicate=lit("holds"), evidence=F.array(cat("e-", n)))

    def evidence(n: Column) -> Column:
        day = lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=n)
        return js(bom_ref=cat("e-", n), propertyName=cat("p", n), created=lit("2024-01-01T00:00:00Z"), expires=iso(day), author=S(name=lit("auditor")))

    def assessor(k: Column) -> Column:
        return js(bom_ref=cat("a-", k), thirdParty=k % 2 == 0, organization=S(name=cat("S-", k)))

    def own(n: Column) -> Column:
        return n

    numbers, keys = (F.array_distinct(F.transform("line", lambda r: r[n])) for n in ("l_linenumber", "l_suppkey"))  # noqa: B023
    g = g.select("bom_id", texts(col("line"), order, entry).alias("map"), texts(numbers, own, claim).alias("claim"),
                 texts(numbers, own, evidence).alias("ev"), texts(keys, own, assessor).alias("asr"))
    member = lambda n, g_: F.concat(lit(f'"{n}":'), F.coalesce(arr(g_), lit("[]")))
    att = F.concat(lit('"attestations":[{"summary":"s","assessor":"a-0","map":'), F.coalesce(arr("map"), lit("[]")), lit("}]"))
    aff = lit('"affirmation":{"statement":"I affirm","signatories":[{"name":"CEO","role":"chief"},{"name":"CTO","role":"tech"}]}')
    decl = F.concat(lit("{"), F.concat_ws(",", member("assessors", "asr"), att, member("claims", "claim"), member("evidence", "ev"), aff), lit("}"))
    return finish(g, ("declarations", decl))


def standard_docs(t) -> DataFrame:
    """A standard per 64 parts; requirement i under requirement (i-1)/2."""
    k = col("p_partkey")
    i, base = k % 64, F.floor(k / 64) * 64
    p = t.raw("part")
    parent = F.when(i > 0, cat("r-", (base + F.floor((i - 1) / 2)).cast("bigint")))
    r = js(bom_ref=cat("r-", k), identifier=cat("R.", i), title=col("p_name"), parent=parent, openCre=F.array(cat("CRE:", k, "-", k % 10)))
    lv = js(bom_ref=cat("l-", k), identifier=cat("L", i), requirements=F.array(cat("r-", k)))
    block = F.floor(k / 64).cast("bigint")
    order = F.lpad(k.cast("string"), 12, "0")
    rows = items(p, block, "req", order, r).unionByName(items(p.filter(k % 2 == 0), block, "lev", order, lv))
    g = gather(rows, ["req", "lev"])
    std = F.concat(
        lit('{"standards":[{"bom-ref":"std-1","name":"STD","version":"1","owner":"o","requirements":'), F.coalesce(arr("req"), lit("[]")), lit(',"levels":'),
        F.coalesce(arr("lev"), lit("[]")), lit("}]}"),
    )
    return finish(g, ("definitions", std))


def patent_docs(t) -> DataFrame:
    """Patents per 50 parts, a family per 10, an asserting component per part."""
    k = col("p_partkey")
    p = t.raw("part")
    block, order = F.floor(k / 50).cast("bigint"), F.lpad(k.cast("string"), 12, "0")
    pat = js(
        bom_ref=cat("p-", k), patentNumber=cat("US", k), jurisdiction=F.when(k % 2 == 0, "US").otherwise("EP"), title=col("p_name"),
        patentLegalStatus=F.when(k % 3 == 0, "granted").otherwise("pending"), filingDate=lit("2015-01-01T00:00:00Z"),
    )
    fam = p.groupBy(F.floor(k / 10).cast("bigint").alias("f")).agg(F.array_sort(F.collect_list(cat("p-", k))).alias("m"))
    f = js(bom_ref=cat("fam-", col("f")), familyId=cat("F", col("f")), members=col("m"))
    who = F.when(k % 3 == 0, '"org-1"').when(k % 3 == 1, F.to_json(S(name=cat("Org ", k)))).otherwise(F.to_json(S(name=cat("Jo ", k), email=lit("jo@example"))))
    a = F.concat(
        lit('{"type":"library","name":"n","bom-ref":"'), cat("c-", k), lit('","patentAssertions":[{"assertionType":"ownership","patentRefs":["'), cat("p-", k),
        lit('","'), cat("fam-", F.floor(k / 10).cast("bigint")), lit('"],"asserter":'), who, lit("}]}"),
    )
    rows = (
        items(p, block, "pat", order, pat).unionByName(items(fam, F.floor(col("f") / 5).cast("bigint"), "fam", col("f"), f))
        .unionByName(items(p, block, "cmp", order, a))
    )
    g = gather(rows, ["pat", "fam", "cmp"])
    g = g.withColumn("pat", F.concat("pat", "fam"))
    return finish(g, ("components", arr("cmp")), ("definitions", F.concat(lit('{"patents":'), F.coalesce(arr("pat"), lit("[]")), lit("}"))))


def crypto_docs(t) -> DataFrame:
    """Certificates, algorithms, a protocol and key material per ten orders."""
    k = col("o_orderkey")
    o = t.raw("orders")
    block, order = F.floor(k / 10).cast("bigint"), F.lpad(k.cast("string"), 12, "0")
    prim = F.element_at(F.array(*[lit(x) for x in ("ae", "hash", "signature", "kem")]), (k % 4 + 1).cast("int"))
    crypto = "cryptographic-asset"
    alg = js(type=lit(crypto), bom_ref=cat("alg-", k), name=cat("A", k % 20), cryptoProperties=S(assetType=lit("algorithm"), algorithmProperties=S(
        primitive=prim, algorithmFamily=cat("FAM-", k % 6), curve=F.when(k % 4 == 2, "old-curve"), ellipticCurve=F.when(k % 8 == 2, "new-curve"),
        mode=F.when(k % 4 == 0, "gcm"), cryptoFunctions=F.array(lit("generate"), F.when(k % 2 == 0, "sign").otherwise("digest")),
        classicalSecurityLevel=lit(128), nistQuantumSecurityLevel=(k % 7).cast("int")), oid=cat("1.2.", k)))
    states = F.when(col("o_orderstatus") == "F", F.array(S(state=lit("pre-activation")), S(state=lit("active")), S(state=lit("destroyed")))).otherwise(
        F.array(S(state=lit("pre-activation")), S(state=lit("active"))))
    cert = js(type=lit(crypto), bom_ref=cat("cert-", k), name=cat("CN=", col("o_custkey")), cryptoProperties=S(assetType=lit("certificate"), certificateProperties=S(
        subjectName=cat("CN=", col("o_custkey")), notValidBefore=iso(col("o_orderdate")), notValidAfter=iso(col("o_orderdate") + F.expr("INTERVAL '365' DAY")),
        signatureAlgorithmRef=cat("alg-", k), certificateState=states,
        certificateExtensions=F.array(S(commonExtensionName=lit("keyUsage"), commonExtensionValue=lit("sign"), customExtensionName=lit(None).cast("string"))),
        relatedCryptographicAssets=F.array(S(type=lit("publicKey"), ref=cat("key-", k))))))
    key = js(type=lit(crypto), bom_ref=cat("key-", k), name=lit("key"), cryptoProperties=S(assetType=lit("related-crypto-material"), relatedCryptoMaterialProperties=S(
        type=lit("public-key"), state=lit("active"), size=lit(2048), algorithmRef=cat("alg-", k), securedBy=S(mechanism=lit("HSM")))))
    proto = js(type=lit(crypto), bom_ref=cat("tls-", k), name=lit("TLS"), cryptoProperties=S(assetType=lit("protocol"), protocolProperties=S(
        type=lit("tls"), version=lit("1.3"), cipherSuites=F.array(S(name=cat("SUITE-", k % 5), algorithms=F.array(cat("alg-", k), lit("alg-none")))),
        ikev2TransformTypes=S(encr=F.array(S(name=lit("AES"), keyLength=lit(256), algorithm=cat("alg-", k)))))))
    rows = items(o, block, "c", order, alg)
    for g_, it in (("cert", cert), ("key", key), ("tls", proto)):
        rows = rows.unionByName(items(o, block, "c", F.concat(order, lit(g_)), it))
    return finish(gather(rows, ["c"]), ("components", arr("c")))


def model_docs(t) -> DataFrame:
    """A model per part; one energy record per part and activity."""
    e = t.energy.groupBy("model_id", "activity").agg(F.sum(col("kwh").cast("decimal(20,2)")).cast("double").alias("kwh"))
    en = S(activity=col("activity"), energyProviders=F.array(S(energySource=F.when(F.length("activity") % 2 == 0, "wind").otherwise("coal"),
           organization=S(name=cat("Grid ", F.length("activity"))), energyProvided=S(value=col("kwh"), unit=lit("kWh")))),
           activityEnergyCost=S(value=col("kwh"), unit=lit("kWh")), co2CostEquivalent=S(value=col("kwh") / 4, unit=lit("tCO2eq")))
    per = e.groupBy("model_id").agg(F.array_sort(F.collect_list(en)).alias("en"))  # at most seven activities
    k = col("p_partkey")
    p = t.raw("part").join(per, k == col("model_id"), "left")
    value = F.when(k % 10 == 0, "n/a").otherwise((col("p_size") * 2).cast("string"))
    card = S(
        modelParameters=S(approach=S(type=F.when(k % 2 == 0, "supervised").otherwise("unsupervised")), task=col("p_type"), datasets=F.array(S(ref=cat("ds-", k)))),
        quantitativeAnalysis=S(performanceMetrics=F.array(S(type=lit("accuracy"), value=value, slice=col("p_type"),
            confidenceInterval=S(lowerBound=col("p_size").cast("string"), upperBound=(col("p_size") + k % 3).cast("string"))))),
        considerations=S(users=F.array(cat("u-", k % 5)), fairnessAssessments=F.array(S(groupAtRisk=cat("g-", k % 5), harms=lit("h"))),
                         environmentalConsiderations=S(energyConsumptions=col("en"))),
    )
    c = js(type=lit("machine-learning-model"), bom_ref=cat("m-", k), name=col("p_name"), modelCard=card)
    return finish(gather(items(p, F.floor(k / 20).cast("bigint"), "c", F.lpad(k.cast("string"), 12, "0"), c), ["c"]), ("components", arr("c")))


def data_docs(t) -> DataFrame:
    k = col("p_partkey")
    gov = S(custodians=F.array(S(organization=S(name=cat("Org-", k % 10)))), owners=F.array(S(contact=S(name=cat("Own-", k % 3)))))
    c = js(type=lit("data"), bom_ref=cat("d-", k), name=col("p_name"), data=F.array(
        S(type=lit("configuration"), name=cat("f", k), classification=col("p_type"), contents=S(url=cat("https://d/", k)), governance=gov)))
    return finish(gather(items(t.raw("part"), F.floor(k / 25).cast("bigint"), "c", F.lpad(k.cast("string"), 12, "0"), c), ["c"]), ("components", arr("c")))


def evidence_docs(t) -> DataFrame:
    """One component per line whose identity rests on two methods."""
    tech = F.when(col("l_returnflag") == "A", "binary-analysis").when(col("l_returnflag") == "N", "manifest-analysis").otherwise("filename")
    ident = S(field=lit("purl"), confidence=col("l_discount") * 10, concludedValue=cat("pkg:x/", col("l_partkey")),
              methods=F.array(S(technique=tech, confidence=col("l_discount") * 10), S(technique=lit("other"), confidence=col("l_tax"))), tools=F.array(cat("tool-", col("l_suppkey") % 3)))
    ev = S(identity=F.array(ident), occurrences=F.array(S(location=cat("/lib/", col("l_partkey")), line=col("l_linenumber"))),
           callstack=S(frames=F.array(S(module=cat("m", col("l_linenumber")), line=col("l_linenumber")))), copyright=F.array(S(text=cat("Copyright ", col("l_suppkey")))),
           licenses=F.array(S(license=S(id=lit("MIT")))))
    c = js(type=lit("library"), bom_ref=cat("x-", col("l_linenumber")), name=cat("n-", col("l_partkey")), evidence=ev)
    order = F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax")
    g = gather(items(t.line_by_document, col("l_orderkey"), "c", order, c), ["c"])
    tools = lit('{"tools":{"components":[{"type":"application","bom-ref":"tool-0","name":"Zero"},{"type":"application","bom-ref":"tool-1","name":"One"}]}}')
    return finish(g, ("metadata", tools), ("components", arr("c")))


def pedigree_docs(t) -> DataFrame:
    """Components with commits, patches and an ancestor, ten events per document."""
    k = col("event_id")
    purl = lambda x: cat("pkg:e/", x)
    ped = S(
        ancestors=F.array(S(type=lit("library"), bom_ref=cat("anc-", k), name=lit("old"), purl=purl(F.floor(k / 2).cast("bigint")))),
        commits=F.array(S(uid=F.md5(k.cast("string")), author=S(name=cat("u-", col("user_id")), timestamp=iso(col("ts"))))),
        patches=F.array(S(type=F.when(k % 2 == 0, "backport").otherwise("unofficial"), diff=S(url=cat("https://p/", k)),
                          resolves=F.array(S(type=F.when(k % 3 == 0, "security").otherwise("defect"), id=cat("I-", k))))),
    )
    c = js(type=lit("library"), bom_ref=cat("e-", k), name=col("event_type"), purl=purl(k), pedigree=ped,
           releaseNotes=S(type=lit("minor"), title=cat("R", k), timestamp=iso(col("ts")), aliases=F.array(cat("al-", k)), tags=F.array(col("event_type")),
                          resolves=F.array(S(type=lit("defect"), id=cat("I-", k))),
                          notes=F.array(S(locale=lit("en-US"), text=S(content=cat("note ", k))), S(locale=lit("fr"), text=S(content=lit("n"))))))
    return finish(gather(items(t.raw("events"), F.floor(k / 10).cast("bigint"), "c", F.lpad(k.cast("string"), 12, "0"), c), ["c"]), ("components", arr("c")))


def citation_docs(t) -> DataFrame:
    """Each order cites the name of its component and one expression."""
    o, k = t.raw("orders"), col("o_orderkey")
    comp = F.concat(lit("["), js(type=lit("library"), bom_ref=lit("c-1"), name=cat("n/", k)), lit("]"))
    cites = F.concat(
        lit("["), js(bom_ref=lit("x-1"), pointers=F.array(lit("/components/0/name"), lit("/components/9/name")), timestamp=iso(col("o_orderdate")),
                     attributedTo=F.when(k % 3 != 0, cat("org-", k % 4)), process=F.when(k % 3 == 1, "p-1")),
        lit(","), js(bom_ref=lit("x-2"), expressions=F.array(lit("$..name")), timestamp=iso(col("o_orderdate")), process=lit("p-2")), lit("]"),
    )
    return finish(o.select(k.alias("bom_id"), "o_orderkey", "o_orderdate"), ("components", comp), ("citations", cites))
