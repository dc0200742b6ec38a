"""Shapes of a document in JSON spelling, as DDL text.

Recursive members (a component in a component, an ancestor of a component) are
``variant``: one level is read per round of the flattening loop. Large optional
sections are ``variant`` too and are read only by the operator that needs them.
Unset members read as null. Times stay text until a table gives them a type.
"""

ATTACHMENT = "struct<contentType string, encoding string, content string>"
HASHES = "array<struct<alg string, content string>>"
PROPERTIES = "array<struct<name string, value string>>"
EXTERNAL_REFERENCES = f"array<struct<type string, url string, comment string, hashes {HASHES}, properties {PROPERTIES}>>"
ADDRESS = (
    "struct<`bom-ref` string, country string, region string, locality string, postOfficeBoxNumber string, "
    "postalCode string, streetAddress string>"
)
CONTACT = "struct<`bom-ref` string, name string, email string, phone string>"
ORGANIZATION = f"struct<`bom-ref` string, name string, address {ADDRESS}, url array<string>, contact array<{CONTACT}>>"
PARTY = f"struct<organization {ORGANIZATION}, individual {CONTACT}>"
LICENSING = (
    f"struct<altIds array<string>, licensor {PARTY}, licensee {PARTY}, purchaser {PARTY}, purchaseOrder string, "
    "licenseTypes array<string>, lastRenewal string, expiration string>"
)
LICENSES = (
    f"array<struct<license struct<`bom-ref` string, id string, name string, acknowledgement string, text {ATTACHMENT}, "
    f"url string, licensing {LICENSING}, properties {PROPERTIES}>, expression string, "
    f"expressionDetails array<struct<licenseIdentifier string, `bom-ref` string, text {ATTACHMENT}, url string>>, "
    f"acknowledgement string, `bom-ref` string, licensing {LICENSING}, properties {PROPERTIES}>>"
)
SOURCE = "struct<name string, url string>"
ISSUE = (
    f"struct<type string, id string, name string, description string, source {SOURCE}, references array<string>>"
)
SWID = (
    f"struct<tagId string, name string, version string, tagVersion int, patch boolean, text {ATTACHMENT}, url string>"
)
PATENT_ASSERTIONS = (
    "array<struct<`bom-ref` string, assertionType string, patentRefs array<string>, asserter variant, notes string>>"
)
COMPONENT = (
    "struct<type string, `mime-type` string, `bom-ref` string, "
    f"supplier {ORGANIZATION}, manufacturer {ORGANIZATION}, authors array<{CONTACT}>, author string, publisher string, "
    f"`group` string, name string, version string, versionRange string, isExternal boolean, description string, scope string, "
    f"hashes {HASHES}, licenses {LICENSES}, copyright string, cpe string, purl string, omniborId array<string>, "
    f"swhid array<string>, swid {SWID}, modified boolean, pedigree variant, externalReferences {EXTERNAL_REFERENCES}, "
    f"components array<variant>, evidence variant, releaseNotes variant, modelCard variant, data variant, "
    f"cryptoProperties variant, properties {PROPERTIES}, tags array<string>, patentAssertions {PATENT_ASSERTIONS}>"
)
GOVERNANCE_PARTY = f"struct<organization {ORGANIZATION}, contact {CONTACT}>"
GOVERNANCE = (
    f"struct<custodians array<{GOVERNANCE_PARTY}>, stewards array<{GOVERNANCE_PARTY}>, owners array<{GOVERNANCE_PARTY}>>"
)
DATA_FLOWS = (
    "array<struct<flow string, classification string, name string, description string, governance "
    f"{GOVERNANCE}, source array<string>, destination array<string>>>"
)
SERVICE = (
    f"struct<`bom-ref` string, provider {ORGANIZATION}, `group` string, name string, version string, description string, "
    f"endpoints array<string>, authenticated boolean, `x-trust-boundary` boolean, trustZone string, data {DATA_FLOWS}, "
    f"licenses {LICENSES}, externalReferences {EXTERNAL_REFERENCES}, services array<variant>, releaseNotes variant, "
    f"properties {PROPERTIES}, tags array<string>, patentAssertions {PATENT_ASSERTIONS}>"
)
PEDIGREE = (
    "struct<ancestors array<variant>, descendants array<variant>, variants array<variant>, "
    "commits array<struct<uid string, url string, author struct<timestamp string, name string, email string>, "
    "committer struct<timestamp string, name string, email string>, message string>>, "
    f"patches array<struct<type string, diff struct<text {ATTACHMENT}, url string>, resolves array<{ISSUE}>>>, notes string>"
)
EVIDENCE_IDENTITY = (
    "struct<field string, confidence double, concludedValue string, "
    "methods array<struct<technique string, confidence double, value string>>, tools array<string>>"
)
EVIDENCE = (
    f"struct<identity variant, occurrences array<struct<`bom-ref` string, location string, line int, `offset` int, symbol string, "
    "additionalContext string>>, callstack struct<frames array<struct<package string, module string, `function` string, "
    "parameters array<string>, line int, `column` int, fullFilename string>>>, "
    f"licenses {LICENSES}, copyright array<struct<text string>>>"
)
RELEASE_NOTES = (
    "struct<type string, title string, featuredImage string, socialImage string, description string, timestamp string, "
    f"aliases array<string>, tags array<string>, resolves array<{ISSUE}>, notes array<struct<locale string, text {ATTACHMENT}>>, "
    f"properties {PROPERTIES}>"
)
COMPONENT_DATA = (
    f"struct<`bom-ref` string, type string, name string, contents struct<attachment {ATTACHMENT}, url string, "
    f"properties {PROPERTIES}>, classification string, sensitiveData array<string>, description string, governance {GOVERNANCE}>"
)
MEASURE = "struct<value double, unit string>"
MODEL_CARD = (
    "struct<`bom-ref` string, modelParameters struct<approach struct<type string>, task string, architectureFamily string, "
    "modelArchitecture string, datasets array<variant>, inputs array<struct<format string>>, outputs array<struct<format string>>>, "
    "quantitativeAnalysis struct<performanceMetrics array<struct<type string, value string, slice string, "
    "confidenceInterval struct<lowerBound string, upperBound string>>>>, "
    "considerations struct<users array<string>, useCases array<string>, technicalLimitations array<string>, "
    "performanceTradeoffs array<string>, ethicalConsiderations array<struct<name string, mitigationStrategy string>>, "
    "environmentalConsiderations struct<energyConsumptions array<struct<activity string, energyProviders array<struct<`bom-ref` string, "
    f"description string, organization {ORGANIZATION}, energySource string, energyProvided {MEASURE}, "
    f"externalReferences {EXTERNAL_REFERENCES}>>, activityEnergyCost {MEASURE}, co2CostEquivalent {MEASURE}, co2CostOffset {MEASURE}>>>, "
    "fairnessAssessments array<struct<groupAtRisk string, benefits string, harms string, mitigationStrategy string>>>>"
)
RELATED_ASSETS = "array<struct<type string, ref string>>"
CRYPTO = (
    "struct<assetType string, algorithmProperties struct<primitive string, algorithmFamily string, parameterSetIdentifier string, "
    "curve string, ellipticCurve string, executionEnvironment string, implementationPlatform string, "
    "certificationLevel array<string>, mode string, padding string, cryptoFunctions array<string>, "
    "classicalSecurityLevel int, nistQuantumSecurityLevel int>, "
    "certificateProperties struct<serialNumber string, subjectName string, issuerName string, notValidBefore string, "
    "notValidAfter string, signatureAlgorithmRef string, subjectPublicKeyRef string, certificateFormat string, "
    "certificateExtension string, certificateFileExtension string, fingerprint struct<alg string, content string>, "
    "certificateState array<struct<state string, reason string, name string, description string>>, creationDate string, "
    "activationDate string, deactivationDate string, revocationDate string, destructionDate string, "
    "certificateExtensions array<struct<commonExtensionName string, commonExtensionValue string, customExtensionName string, "
    f"customExtensionValue string>>, relatedCryptographicAssets {RELATED_ASSETS}>, "
    "relatedCryptoMaterialProperties struct<type string, id string, state string, algorithmRef string, creationDate string, "
    "activationDate string, updateDate string, expirationDate string, value string, size bigint, format string, "
    "securedBy struct<mechanism string, algorithmRef string>, fingerprint struct<alg string, content string>, "
    f"relatedCryptographicAssets {RELATED_ASSETS}>, "
    "protocolProperties struct<type string, version string, cipherSuites array<struct<name string, algorithms array<string>, "
    "identifiers array<string>, tlsGroups array<string>, tlsSignatureSchemes array<string>>>, "
    "ikev2TransformTypes struct<encr array<variant>, prf array<variant>, integ array<variant>, ke array<variant>, esn boolean, "
    f"auth array<variant>>, cryptoRefArray array<string>, relatedCryptographicAssets {RELATED_ASSETS}>, oid string>"
)
VULNERABILITIES = (
    f"array<struct<`bom-ref` string, id string, source {SOURCE}, references array<struct<id string, source {SOURCE}>>, "
    f"ratings array<struct<source {SOURCE}, score double, severity string, method string, vector string, justification string>>, "
    "cwes array<int>, description string, detail string, recommendation string, workaround string, "
    f"proofOfConcept struct<reproductionSteps string, environment string, supportingMaterial array<{ATTACHMENT}>>, "
    "advisories array<struct<title string, url string>>, created string, published string, updated string, rejected string, "
    f"credits struct<organizations array<{ORGANIZATION}>, individuals array<{CONTACT}>>, "
    "analysis struct<state string, justification string, response array<string>, detail string, firstIssued string, lastUpdated string>, "
    "affects array<struct<ref string, versions array<struct<version string, `range` string, status string>>>>, "
    f"properties {PROPERTIES}>>"
)
RESOURCE = f"struct<ref string, externalReference struct<type string, url string>>"
INPUTS = (
    f"array<struct<source {RESOURCE}, target {RESOURCE}, resource {RESOURCE}, parameters array<struct<name string, value string, "
    f"dataType string>>, environmentVars array<variant>, data {ATTACHMENT}>>"
)
OUTPUTS = (
    f"array<struct<type string, source {RESOURCE}, target {RESOURCE}, resource {RESOURCE}, data {ATTACHMENT}, "
    "environmentVars array<variant>>>"
)
STEPS = f"array<struct<name string, description string, commands array<struct<executed string>>>>"
TRIGGER = (
    f"struct<`bom-ref` string, uid string, name string, type string, event struct<uid string, description string, "
    f"timeReceived string, source {RESOURCE}, target {RESOURCE}>, conditions array<struct<description string, expression string>>, "
    "timeActivated string>"
)
WORKSPACES = (
    "array<struct<`bom-ref` string, uid string, name string, aliases array<string>, accessMode string, mountPath string, "
    "managedDataType string, volumeRequest string, volume struct<uid string, name string, mode string, path string, "
    "sizeAllocated string, persistent boolean, remote boolean>>>"
)
GRAPH = "array<struct<ref string, dependsOn array<string>, provides array<string>>>"
_RUN = (
    f"`bom-ref` string, uid string, name string, description string, resourceReferences array<{RESOURCE}>, taskTypes array<string>, "
    f"trigger {TRIGGER}, steps {STEPS}, inputs {INPUTS}, outputs {OUTPUTS}, timeStart string, timeEnd string, "
    f"workspaces {WORKSPACES}, runtimeTopology {GRAPH}"
)
WORKFLOWS = f"array<struct<{_RUN}, tasks array<struct<{_RUN}>>, taskDependencies {GRAPH}>>"
FORMULATION = (
    f"array<struct<`bom-ref` string, components array<variant>, services array<variant>, workflows {WORKFLOWS}, properties {PROPERTIES}>>"
)
DECLARATIONS = (
    f"struct<assessors array<struct<`bom-ref` string, thirdParty boolean, organization {ORGANIZATION}>>, "
    "attestations array<struct<summary string, assessor string, map array<struct<requirement string, claims array<string>, "
    "counterClaims array<string>, conformance struct<score double, rationale string, mitigationStrategies array<string>>, "
    "confidence struct<score double, rationale string>>>>>, "
    "claims array<struct<`bom-ref` string, target string, predicate string, mitigationStrategies array<string>, reasoning string, "
    f"evidence array<string>, counterEvidence array<string>, externalReferences {EXTERNAL_REFERENCES}>>, "
    f"evidence array<struct<`bom-ref` string, propertyName string, description string, created string, expires string, "
    f"author {CONTACT}, reviewer {CONTACT}, data array<struct<name string, classification string, sensitiveData array<string>, "
    f"governance {GOVERNANCE}>>>>, "
    f"targets struct<organizations array<{ORGANIZATION}>, components array<variant>, services array<variant>>, "
    f"affirmation struct<statement string, signatories array<struct<name string, role string, organization {ORGANIZATION}>>>>"
)
DEFINITIONS = (
    "struct<standards array<struct<`bom-ref` string, name string, version string, description string, owner string, "
    "requirements array<struct<`bom-ref` string, identifier string, title string, text string, descriptions array<string>, "
    f"openCre array<string>, parent string, properties {PROPERTIES}, externalReferences {EXTERNAL_REFERENCES}>>, "
    "levels array<struct<`bom-ref` string, identifier string, title string, description string, requirements array<string>>>, "
    f"externalReferences {EXTERNAL_REFERENCES}>>, "
    "patents array<struct<`bom-ref` string, patentNumber string, applicationNumber string, jurisdiction string, "
    "priorityApplication struct<applicationNumber string, jurisdiction string, filingDate string>, publicationNumber string, "
    "title string, filingDate string, grantDate string, patentExpirationDate string, patentLegalStatus string, "
    f"patentAssignee array<variant>, familyId string, members array<string>, externalReferences {EXTERNAL_REFERENCES}>>>"
)
ANNOTATIONS = (
    f"array<struct<`bom-ref` string, subjects array<string>, annotator struct<organization {ORGANIZATION}, individual {CONTACT}, "
    "component variant, service variant>, timestamp string, text string>>"
)
COMPOSITIONS = (
    "array<struct<`bom-ref` string, aggregate string, assemblies array<string>, dependencies array<string>, vulnerabilities array<string>>>"
)
CITATIONS = (
    "array<struct<`bom-ref` string, pointers array<string>, expressions array<string>, timestamp string, attributedTo string, "
    "process string, note string>>"
)
METADATA = (
    f"struct<timestamp string, lifecycles array<struct<phase string, name string, description string>>, tools variant, "
    f"authors array<{CONTACT}>, component variant, manufacture {ORGANIZATION}, manufacturer {ORGANIZATION}, supplier {ORGANIZATION}, "
    f"licenses {LICENSES}, properties {PROPERTIES}, distributionConstraints struct<tlp string>>"
)
DOCUMENT = (
    f"`$schema` string, bomFormat string, specVersion string, serialNumber string, version string, metadata {METADATA}, "
    f"components array<variant>, services array<variant>, externalReferences {EXTERNAL_REFERENCES}, dependencies {GRAPH}, "
    f"compositions {COMPOSITIONS}, vulnerabilities {VULNERABILITIES}, annotations {ANNOTATIONS}, properties {PROPERTIES}, "
    f"formulation {FORMULATION}, declarations {DECLARATIONS}, definitions {DEFINITIONS}, citations {CITATIONS}"
)

# Shapes of members that the shapes above leave open or hold in part; read by walks over whole documents.
_PART = "struct<name string, algorithm string>"
GRAPHICS = f"struct<description string, collection array<struct<name string, image {ATTACHMENT}>>>"
OPEN_MEMBERS = {
    "asserter": f"struct<organization {ORGANIZATION}, individual {CONTACT}, ref string>", "patentAssignee": f"array<{PARTY}>",
    "environmentVars": "array<struct<name string, value string>>", "externalReference": EXTERNAL_REFERENCES.removeprefix("array<")[:-1],
    "encr": "array<struct<name string, keyLength int, algorithm string>>", "prf": f"array<{_PART}>", "integ": f"array<{_PART}>",
    "ke": "array<struct<`group` int, algorithm string>>", "auth": f"array<{_PART}>",
}
_OWN_PROPERTIES = f"properties {PROPERTIES}"
_RESOURCES = f"resourceReferences array<{RESOURCE}>"
#: Members of a kind of object beside those of its shape.
MORE_MEMBERS = {
    **dict.fromkeys(
        "modelCard environmentalConsiderations energyConsumption workflow task volume steps commands conditions input output".split(),
        _OWN_PROPERTIES,
    ),
    "event": f"{_OWN_PROPERTIES}, data {ATTACHMENT}",
    "trigger": f"description string, {_OWN_PROPERTIES}, {_RESOURCES}, inputs {INPUTS}, outputs {OUTPUTS}",
    "workspace": f"description string, {_OWN_PROPERTIES}, {_RESOURCES}",
    "quantitativeAnalysis": f"graphics {GRAPHICS}", "data": f"graphics {GRAPHICS}, ref string",
    "evidence.data": f"contents struct<attachment {ATTACHMENT}, url string>", "signatory": "externalReference variant",
    "vulnerability": "tools variant", "patent": "abstract string",
}
