"""XML documents against the same documents in JSON: every table that the JSON operators give."""

import json

import pytest
from frames import doc_frame
from pyspark.sql import functions as F

from bomspark.operators import flatten as X, rules
from bomspark.sources import documents, xml_json

XML = """<?xml version="1.0"?>
<bom xmlns="http://example.org/schema/bom/1.6" serialNumber="urn:uuid:00000000-0000-0000-0000-0000000000a1" version="3">
 <metadata><timestamp>2024-01-02T03:04:05Z</timestamp>
  <tools><tool><vendor>acme</vendor><name>scan</name><version>1.10</version><hashes><hash alg="MD5">00ff</hash></hashes></tool></tools>
  <authors><author bom-ref="au"><name>Ann</name><email>a@x.org</email></author></authors>
  <component type="application" bom-ref="main"><name>app</name><version>1.10</version></component>
  <supplier bom-ref="sup"><name>Sup</name><address bom-ref="adr"><country>DE</country></address><url>https://a.org</url><url>https://b.org</url><contact bom-ref="c1"><name>Bo</name></contact></supplier>
  <properties><property name="k">v</property></properties>
 </metadata>
 <components>
  <component type="library" bom-ref="a" mime-type="text/plain"><name>a</name><version>01</version><modified>false</modified>
   <hashes><hash alg="SHA-1">aa</hash><hash alg="MD5">bb</hash></hashes>
   <licenses><license bom-ref="l1" acknowledgement="declared"><id>MIT</id><text content-type="text/plain" encoding="base64">TUlU</text><url>https://l.org</url></license></licenses>
   <swid tagId="t" name="n" version="2" tagVersion="4" patch="true"/><omniborId>gitoid:blob:sha1:aa</omniborId><omniborId>gitoid:blob:sha1:bb</omniborId>
   <pedigree><ancestors><component type="library" bom-ref="anc"><name>anc</name></component></ancestors>
    <commits><commit><uid>7</uid><author><name>Cy</name></author></commit></commits>
    <patches><patch type="backport"><diff><url>d</url></diff><resolves><issue type="security"><id>I-1</id><source><name>s</name></source><references><url>r1</url><url>r2</url></references></issue></resolves></patch></patches>
    <notes>n</notes></pedigree>
   <externalReferences><reference type="vcs"><url>git</url><comment>c</comment><hashes><hash alg="MD5">cc</hash></hashes></reference></externalReferences>
   <components><component type="file" bom-ref="in"><name>inner</name><components><component type="file" bom-ref="in2"><name>inner2</name></component></components></component></components>
   <evidence><identity><field>purl</field><confidence>0.5</confidence><concludedValue>p</concludedValue><methods><method><technique>filename</technique><confidence>0.25</confidence><value>f</value></method></methods><tools><tool ref="main"/></tools></identity>
    <occurrences><occurrence bom-ref="oc"><location>/x</location><line>3</line></occurrence></occurrences>
    <callstack><frames><frame><package>p</package><module>m</module><parameters><parameter>x</parameter><parameter>y</parameter></parameters><line>9</line></frame></frames></callstack>
    <copyright><text>(c) one</text><text>(c) two</text></copyright></evidence>
   <releaseNotes><type>major</type><title>t</title><aliases><alias>x</alias></aliases><notes><note><locale>en</locale><text>hi</text></note></notes></releaseNotes>
   <tags><tag>one</tag><tag>two</tag></tags>
  </component>
  <component type="machine-learning-model" bom-ref="ml"><name>ml</name>
   <licenses><expression acknowledgement="concluded" bom-ref="e1">MIT OR ISC</expression></licenses>
   <modelCard bom-ref="mc"><modelParameters><approach><type>supervised</type></approach><task>t</task><inputs><input><format>png</format></input></inputs></modelParameters>
    <quantitativeAnalysis><performanceMetrics><performanceMetric><type>f1</type><value>0.9</value><confidenceInterval><lowerBound>0.8</lowerBound><upperBound>1.0</upperBound></confidenceInterval></performanceMetric></performanceMetrics></quantitativeAnalysis>
    <considerations><users><user>u</user></users><ethicalConsiderations><ethicalConsideration><name>e</name><mitigationStrategy>m</mitigationStrategy></ethicalConsideration></ethicalConsiderations>
     <environmentalConsiderations><energyConsumptions><energyConsumption><activity>training</activity><energyProviders bom-ref="ep"><organization><name>o</name></organization><energySource>solar</energySource><energyProvided><value>2.5</value><unit>kWh</unit></energyProvided></energyProviders><activityEnergyCost><value>1.5</value><unit>kWh</unit></activityEnergyCost></energyConsumption></energyConsumptions></environmentalConsiderations>
    </considerations></modelCard></component>
  <component type="data" bom-ref="dt"><name>dt</name><data bom-ref="d1"><type>dataset</type><name>ds</name><classification>public</classification><governance><owners><owner><organization><name>own</name></organization></owner></owners></governance></data></component>
  <component type="cryptographic-asset" bom-ref="cr"><name>aes</name><cryptoProperties><assetType>algorithm</assetType>
   <algorithmProperties><primitive>ae</primitive><certificationLevel>none</certificationLevel><cryptoFunctions><cryptoFunction>encrypt</cryptoFunction><cryptoFunction>decrypt</cryptoFunction></cryptoFunctions><nistQuantumSecurityLevel>1</nistQuantumSecurityLevel></algorithmProperties><oid>1.2</oid></cryptoProperties></component>
 </components>
 <services><service bom-ref="s"><provider><name>P</name></provider><name>svc</name><endpoints><endpoint>https://e</endpoint></endpoints><authenticated>true</authenticated><x-trust-boundary>true</x-trust-boundary>
  <data><dataflow name="df"><classification flow="inbound">PII</classification><source><url>s1</url></source></dataflow></data>
  <services><service bom-ref="s2"><name>nested</name></service></services></service></services>
 <externalReferences><reference type="website"><url>https://w</url></reference></externalReferences>
 <dependencies><dependency ref="main"><dependency ref="a"/><dependency ref="ml"/></dependency><dependency ref="a"><provides ref="cr"/></dependency><dependency ref="dt"/></dependencies>
 <compositions><composition bom-ref="co"><aggregate>complete</aggregate><assemblies><assembly ref="a"/></assemblies><dependencies><dependency ref="main"/></dependencies></composition></compositions>
 <properties><property name="dk">dv</property></properties>
 <vulnerabilities><vulnerability bom-ref="v1"><id>CVE-1</id><source><name>NVD</name></source><references><reference><id>G-1</id><source><name>gh</name></source></reference></references>
  <ratings><rating><source><name>NVD</name></source><score>7.5</score><severity>high</severity><method>CVSSv3</method></rating></ratings><cwes><cwe>79</cwe><cwe>80</cwe></cwes>
  <advisories><advisory><title>A</title><url>u</url></advisory></advisories><created>2024-02-01T00:00:00Z</created>
  <credits><individuals><individual><name>Di</name></individual></individuals></credits>
  <analysis><state>exploitable</state><responses><response>update</response><response>rollback</response></responses></analysis>
  <affects><target><ref>a</ref><versions><version><version>1</version><status>affected</status></version><version><range>vers:generic/>=2</range><status>unaffected</status></version></versions></target></affects></vulnerability></vulnerabilities>
 <annotations><annotation bom-ref="an"><subjects><subject ref="a"/><subject ref="s"/></subjects><annotator><individual><name>Ed</name></individual></annotator><timestamp>2024-03-01T00:00:00Z</timestamp><text>note</text></annotation></annotations>
 <formulation><formula bom-ref="f"><components><component type="platform" bom-ref="pl"><name>pl</name></component></components>
  <workflows><workflow bom-ref="w"><uid>w1</uid><tasks><task bom-ref="t1"><uid>t1</uid><taskTypes><taskType>build</taskType></taskTypes><steps><step><name>st</name><commands><command><executed>make</executed></command></commands></step></steps>
   <inputs><input><resource><ref>a</ref></resource></input></inputs></task></tasks><taskDependencies><dependency ref="t1"/></taskDependencies><taskTypes><taskType>build</taskType></taskTypes></workflow></workflows></formula></formulation>
 <declarations><assessors><assessor bom-ref="as"><thirdParty>true</thirdParty><organization><name>As</name></organization></assessor></assessors>
  <attestations><attestation><summary>sum</summary><assessor>as</assessor><map><requirement>rq</requirement><claims><claim>cl</claim></claims><conformance><score>0.8</score><rationale>r</rationale></conformance></map></attestation></attestations>
  <claims><claim bom-ref="cl"><target>a</target><predicate>p</predicate><evidence>ev</evidence></claim></claims>
  <evidence><evidence bom-ref="ev"><propertyName>pn</propertyName><description>d</description></evidence></evidence></declarations>
 <definitions><standards><standard bom-ref="sd"><name>std</name><requirements><requirement bom-ref="rq"><identifier>1</identifier><title>t</title><openCre>CRE:1-2</openCre></requirement></requirements><levels><level bom-ref="lv"><identifier>L1</identifier><requirements><requirement>rq</requirement></requirements></level></levels></standard></standards></definitions>
</bom>"""

JSON = {
    "bomFormat": "X", "specVersion": "1.6", "serialNumber": "urn:uuid:00000000-0000-0000-0000-0000000000a1", "version": 3,
    "metadata": {
        "timestamp": "2024-01-02T03:04:05Z",
        "tools": [{"vendor": "acme", "name": "scan", "version": "1.10", "hashes": [{"alg": "MD5", "content": "00ff"}]}],
        "authors": [{"bom-ref": "au", "name": "Ann", "email": "a@x.org"}],
        "component": {"type": "application", "bom-ref": "main", "name": "app", "version": "1.10"},
        "supplier": {"bom-ref": "sup", "name": "Sup", "address": {"bom-ref": "adr", "country": "DE"}, "url": ["https://a.org", "https://b.org"], "contact": [{"bom-ref": "c1", "name": "Bo"}]},
        "properties": [{"name": "k", "value": "v"}],
    },
    "components": [
        {
            "type": "library", "bom-ref": "a", "mime-type": "text/plain", "name": "a", "version": "01", "modified": False,
            "hashes": [{"alg": "SHA-1", "content": "aa"}, {"alg": "MD5", "content": "bb"}],
            "licenses": [{"license": {"bom-ref": "l1", "acknowledgement": "declared", "id": "MIT", "text": {"contentType": "text/plain", "encoding": "base64", "content": "TUlU"}, "url": "https://l.org"}}],
            "swid": {"tagId": "t", "name": "n", "version": "2", "tagVersion": 4, "patch": True}, "omniborId": ["gitoid:blob:sha1:aa", "gitoid:blob:sha1:bb"],
            "pedigree": {
                "ancestors": [{"type": "library", "bom-ref": "anc", "name": "anc"}], "commits": [{"uid": "7", "author": {"name": "Cy"}}],
                "patches": [{"type": "backport", "diff": {"url": "d"}, "resolves": [{"type": "security", "id": "I-1", "source": {"name": "s"}, "references": ["r1", "r2"]}]}],
                "notes": "n",
            },
            "externalReferences": [{"type": "vcs", "url": "git", "comment": "c", "hashes": [{"alg": "MD5", "content": "cc"}]}],
            "components": [{"type": "file", "bom-ref": "in", "name": "inner", "components": [{"type": "file", "bom-ref": "in2", "name": "inner2"}]}],
            "evidence": {
                "identity": [{"field": "purl", "confidence": 0.5, "concludedValue": "p", "methods": [{"technique": "filename", "confidence": 0.25, "value": "f"}], "tools": ["main"]}],
                "occurrences": [{"bom-ref": "oc", "location": "/x", "line": 3}],
                "callstack": {"frames": [{"package": "p", "module": "m", "parameters": ["x", "y"], "line": 9}]},
                "copyright": [{"text": "(c) one"}, {"text": "(c) two"}],
            },
            "releaseNotes": {"type": "major", "title": "t", "aliases": ["x"], "notes": [{"locale": "en", "text": {"content": "hi"}}]},
            "tags": ["one", "two"],
        },
        {
            "type": "machine-learning-model", "bom-ref": "ml", "name": "ml", "licenses": [{"acknowledgement": "concluded", "bom-ref": "e1", "expression": "MIT OR ISC"}],
            "modelCard": {
                "bom-ref": "mc", "modelParameters": {"approach": {"type": "supervised"}, "task": "t", "inputs": [{"format": "png"}]},
                "quantitativeAnalysis": {"performanceMetrics": [{"type": "f1", "value": "0.9", "confidenceInterval": {"lowerBound": "0.8", "upperBound": "1.0"}}]},
                "considerations": {
                    "users": ["u"], "ethicalConsiderations": [{"name": "e", "mitigationStrategy": "m"}],
                    "environmentalConsiderations": {"energyConsumptions": [{"activity": "training", "energyProviders": [{"bom-ref": "ep", "organization": {"name": "o"}, "energySource": "solar", "energyProvided": {"value": 2.5, "unit": "kWh"}}], "activityEnergyCost": {"value": 1.5, "unit": "kWh"}}]},
                },
            },
        },
        {"type": "data", "bom-ref": "dt", "name": "dt", "data": [{"bom-ref": "d1", "type": "dataset", "name": "ds", "classification": "public", "governance": {"owners": [{"organization": {"name": "own"}}]}}]},
        {"type": "cryptographic-asset", "bom-ref": "cr", "name": "aes", "cryptoProperties": {"assetType": "algorithm", "algorithmProperties": {"primitive": "ae", "certificationLevel": ["none"], "cryptoFunctions": ["encrypt", "decrypt"], "nistQuantumSecurityLevel": 1}, "oid": "1.2"}},
    ],
    "services": [
        {
            "bom-ref": "s", "provider": {"name": "P"}, "name": "svc", "endpoints": ["https://e"], "authenticated": True, "x-trust-boundary": True,
            "data": [{"name": "df", "flow": "inbound", "classification": "PII", "source": ["s1"]}], "services": [{"bom-ref": "s2", "name": "nested"}],
        }
    ],
    "externalReferences": [{"type": "website", "url": "https://w"}],
    "dependencies": [{"ref": "main", "dependsOn": ["a", "ml"]}, {"ref": "a", "provides": ["cr"]}, {"ref": "dt", "dependsOn": []}],
    "compositions": [{"bom-ref": "co", "aggregate": "complete", "assemblies": ["a"], "dependencies": ["main"]}],
    "properties": [{"name": "dk", "value": "dv"}],
    "vulnerabilities": [
        {
            "bom-ref": "v1", "id": "CVE-1", "source": {"name": "NVD"}, "references": [{"id": "G-1", "source": {"name": "gh"}}],
            "ratings": [{"source": {"name": "NVD"}, "score": 7.5, "severity": "high", "method": "CVSSv3"}], "cwes": [79, 80], "advisories": [{"title": "A", "url": "u"}],
            "created": "2024-02-01T00:00:00Z", "credits": {"individuals": [{"name": "Di"}]}, "analysis": {"state": "exploitable", "response": ["update", "rollback"]},
            "affects": [{"ref": "a", "versions": [{"version": "1", "status": "affected"}, {"range": "vers:generic/>=2", "status": "unaffected"}]}],
        }
    ],
    "annotations": [{"bom-ref": "an", "subjects": ["a", "s"], "annotator": {"individual": {"name": "Ed"}}, "timestamp": "2024-03-01T00:00:00Z", "text": "note"}],
    "formulation": [
        {
            "bom-ref": "f", "components": [{"type": "platform", "bom-ref": "pl", "name": "pl"}],
            "workflows": [
                {
                    "bom-ref": "w", "uid": "w1",
                    "tasks": [{"bom-ref": "t1", "uid": "t1", "taskTypes": ["build"], "steps": [{"name": "st", "commands": [{"executed": "make"}]}], "inputs": [{"resource": {"ref": "a"}}]}],
                    "taskDependencies": [{"ref": "t1", "dependsOn": []}], "taskTypes": ["build"],
                }
            ],
        }
    ],
    "declarations": {
        "assessors": [{"bom-ref": "as", "thirdParty": True, "organization": {"name": "As"}}],
        "attestations": [{"summary": "sum", "assessor": "as", "map": [{"requirement": "rq", "claims": ["cl"], "conformance": {"score": 0.8, "rationale": "r"}}]}],
        "claims": [{"bom-ref": "cl", "target": "a", "predicate": "p", "evidence": ["ev"]}],
        "evidence": [{"bom-ref": "ev", "propertyName": "pn", "description": "d"}],
    },
    "definitions": {"standards": [{"bom-ref": "sd", "name": "std", "requirements": [{"bom-ref": "rq", "identifier": "1", "title": "t", "openCre": ["CRE:1-2"]}], "levels": [{"bom-ref": "lv", "identifier": "L1", "requirements": ["rq"]}]}]},
}


@pytest.fixture()
def xml(spark):
    def make(*texts):
        raw = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source_path string, content string")
        return xml_json.xml_documents(raw, "X").withColumn("bom_id", F.col("source_path"))

    return make


def test_every_section_is_the_json_document(spark):
    got = json.loads(xml_json.document_json(XML, xml_json.document_shapes(), "X"))
    for part in JSON:
        assert got[part] == JSON[part], part
    assert set(got) == set(JSON)


def test_tables_agree(spark, xml):
    one, two = xml(XML), doc_frame(spark, json.dumps(JSON))

    def tables(docs):
        named = {"bom": X.bom_table(docs), "edge": X.explode_dependencies(docs), "annotation": X.explode_annotations(docs), "composition": X.explode_compositions(docs)}
        return {k: sorted(map(str, t.collect())) for k, t in named.items()}

    left, right = tables(one), tables(two)
    assert left == right and all(right.values())


def test_broken_deep_and_unknown(spark, xml):
    n = 4_000
    deep = "<bom xmlns='http://example.org/schema/bom/1.6'><dependencies>" + "".join(f"<dependency ref='{i}'>" for i in range(n)) + "</dependency>" * n + "</dependencies></bom>"
    strange = "<bom xmlns='http://example.org/schema/bom/1.5'><components><component type='library'><name>x</name><speed>9</speed></component></components><tags/></bom>"
    docs = xml("<bom><open></bom>", deep, strange, "", None)
    good, bad = documents.quarantine_corrupt(docs)
    assert {r.bom_id for r in good.collect()} == {"1", "2"} and bad.count() >= 2
    edges = X.explode_dependencies(docs.filter("bom_id = '1'")).filter("target is not null")
    assert edges.count() == n - 1
    broken = rules.validate(docs.filter("bom_id = '2'"), bom_format="X")
    assert broken.filter("rule like '%unknown%' and pointer like '%components%'").count() > 0
