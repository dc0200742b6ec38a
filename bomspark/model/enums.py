"""Closed value lists of the document model and their orders.

Fixed values: the spellings below are the ones documents carry, in the order
the model lists them.
"""

from __future__ import annotations

COMPONENT_TYPES = (
    "application framework library operating-system device file container firmware device-driver platform "
    "machine-learning-model data cryptographic-asset"
).split()
SCOPES = "required optional excluded".split()
HASH_ALGS = (
    "MD5 SHA-1 SHA-256 SHA-384 SHA-512 SHA3-256 SHA3-384 SHA3-512 BLAKE2b-256 BLAKE2b-384 BLAKE2b-512 BLAKE3 "
    "Streebog-256 Streebog-512"
).split()
HASH_DIGITS = {
    "MD5": 32, "SHA-1": 40, "SHA-256": 64, "SHA-384": 96, "SHA-512": 128, "SHA3-256": 64, "SHA3-384": 96,
    "SHA3-512": 128, "BLAKE2b-256": 64, "BLAKE2b-384": 96, "BLAKE2b-512": 128, "Streebog-256": 64, "Streebog-512": 128,
}
WEAK_HASHES = ("MD5", "SHA-1")
REFERENCE_TYPES = (
    "other vcs issue-tracker website advisories bom mailing-list social chat documentation support distribution license "
    "build-meta build-system security-contact attestation threat-model adversary-model risk-assessment "
    "distribution-intake vulnerability-assertion exploitability-statement pentest-report static-analysis-report "
    "dynamic-analysis-report runtime-analysis-report component-analysis-report maturity-report certification-report "
    "quality-metrics codified-infrastructure model-card poam log configuration evidence formulation "
    "source-distribution electronic-signature digital-signature rfc-9116 release-notes patent patent-family "
    "patent-assertion citation"
).split()
ISSUE_TYPES = "defect enhancement security".split()
PATCH_TYPES = "unofficial monkey backport cherry-pick".split()
ACKNOWLEDGEMENTS = "declared concluded".split()
LIFECYCLE_PHASES = "design pre-build build post-build operations discovery decommission".split()
TLP = "CLEAR GREEN AMBER AMBER_AND_STRICT RED".split()
FLOW_DIRECTIONS = "inbound outbound bi-directional unknown".split()
AGGREGATES = (
    "not_specified complete incomplete incomplete_first_party_only incomplete_third_party_only unknown "
    "incomplete_first_party_proprietary_only incomplete_first_party_opensource_only "
    "incomplete_third_party_proprietary_only incomplete_third_party_opensource_only"
).split()
SEVERITIES = "critical high medium low info none unknown".split()
SCORE_METHODS = "CVSSv2 CVSSv3 CVSSv31 OWASP other CVSSv4 SSVC".split()
ANALYSIS_STATES = "resolved resolved_with_pedigree exploitable in_triage false_positive not_affected".split()
JUSTIFICATIONS = (
    "code_not_present code_not_reachable requires_configuration requires_dependency requires_environment "
    "protected_by_compiler protected_at_runtime protected_at_perimeter protected_by_mitigating_control"
).split()
RESPONSES = "can_not_fix will_not_fix update rollback workaround_available".split()
AFFECTED_STATUS = "unknown affected unaffected".split()
TECHNIQUES = (
    "source-code-analysis binary-analysis manifest-analysis ast-fingerprint hash-comparison instrumentation "
    "dynamic-analysis filename attestation other"
).split()
EVIDENCE_FIELDS = "group name version purl cpe swid hash omniborId swhid".split()
TASK_TYPES = "copy clone lint scan merge build test deliver deploy release clean other".split()
CERT_STATES = "pre-activation active suspended deactivated revoked destroyed".split()
ENERGY_ACTIVITIES = (
    "other design data-collection data-preparation training fine-tuning validation deployment inference"
).split()

# enum name -> (prefix of the long upper-case spelling, short values in order,
#               does the first long value (number 0) carry meaning?)
ENUMS: dict[str, tuple[str, list[str], bool]] = {
    "component_type": ("CLASSIFICATION_", COMPONENT_TYPES, False),
    "scope": ("SCOPE_", SCOPES, False),
    "hash_alg": ("HASH_ALG_", HASH_ALGS, False),
    "reference_type": ("EXTERNAL_REFERENCE_TYPE_", REFERENCE_TYPES, True),
    "issue_type": ("ISSUE_CLASSIFICATION_", ISSUE_TYPES, False),
    "patch_type": ("PATCH_CLASSIFICATION_", PATCH_TYPES, False),
    "acknowledgement": ("LICENSE_ACKNOWLEDGEMENT_ENUMERATION_", ACKNOWLEDGEMENTS, False),
    "lifecycle_phase": ("LIFECYCLE_PHASE_", LIFECYCLE_PHASES, True),
    "tlp": ("TLP_CLASSIFICATION_", TLP, True),
    "data_flow": ("DATA_FLOW_", FLOW_DIRECTIONS, False),
    "aggregate": ("AGGREGATE_", AGGREGATES, True),
    "severity": ("SEVERITY_", SEVERITIES, False),
    "score_method": ("SCORE_METHOD_", SCORE_METHODS, False),
    "analysis_state": ("IMPACT_ANALYSIS_STATE_", ANALYSIS_STATES, False),
    "justification": ("IMPACT_ANALYSIS_JUSTIFICATION_", JUSTIFICATIONS, False),
    "response": ("VULNERABILITY_RESPONSE_", RESPONSES, False),
    "technique": ("EVIDENCE_TECHNIQUE_", TECHNIQUES, True),
    "evidence_field": ("EVIDENCE_FIELD_", EVIDENCE_FIELDS, False),
    "task_type": ("TASK_TYPE_", TASK_TYPES, True),
    "cert_state": ("PREDEFINED_STATE_", CERT_STATES, False),
    "energy_activity": ("ACTIVITY_TYPE_", ENERGY_ACTIVITIES, False),
}
# Closed lists without a long spelling of their own.
VALUES = {
    "affected_status": AFFECTED_STATUS,
    "license_type": (
        "academic appliance client-access concurrent-user core-points custom-metric device evaluation named-user node-locked oem "
        "perpetual processor-points subscription user other"
    ).split(),
    "crypto_asset": "algorithm certificate protocol related-crypto-material".split(),
    "crypto_primitive": (
        "drbg mac block-cipher stream-cipher signature hash pke xof kdf key-agree kem ae combiner key-wrap other unknown"
    ).split(),
    "crypto_mode": "cbc ecb ccm gcm cfb ofb ctr other unknown".split(),
    "crypto_padding": "pkcs5 pkcs7 pkcs1v15 oaep raw other unknown".split(),
    "crypto_function": (
        "generate keygen encrypt decrypt digest tag keyderive sign verify encapsulate decapsulate other unknown"
    ).split(),
    "crypto_environment": "software-plain-ram software-encrypted-ram software-tee hardware other unknown".split(),
    "crypto_platform": (
        "generic x86_32 x86_64 armv7-a armv7-m armv8-a armv8-m armv9-a armv9-m s390x ppc64 ppc64le other unknown"
    ).split(),
    "crypto_material": (
        "private-key public-key secret-key key ciphertext signature digest initialization-vector nonce seed salt shared-secret "
        "tag additional-data password credential token other unknown"
    ).split(),
    "material_state": "pre-activation active suspended deactivated compromised destroyed".split(),
    "crypto_protocol": "tls ssh ipsec ike sstp wpa dtls quic eap-aka eap-aka-prime prins 5g-aka other unknown".split(),
    "trigger_type": "manual api webhook scheduled".split(),
    "output_type": "artifact attestation log evidence metrics other".split(),
    "access_mode": "read-only read-write read-write-once write-once write-only".split(),
    "volume_mode": "filesystem block".split(),
    "learning_approach": "supervised unsupervised reinforcement-learning semi-supervised self-supervised".split(),
    "energy_source": "coal oil natural-gas nuclear wind solar geothermal hydropower biofuel unknown other".split(),
    "patent_status": (
        "pending granted revoked expired lapsed withdrawn abandoned suspended reinstated opposed terminated invalidated in-force"
    ).split(),
    "patent_assertion": (
        "ownership license third-party-claim standards-inclusion prior-art exclusive-rights non-assertion research-or-evaluation"
    ).split(),
}
# long spellings that do not follow from the short one by upper case and '_'
LONG_SPELLING = {
    "hash_alg": {
        "MD5": "MD_5", "SHA-1": "SHA_1", "SHA3-256": "SHA_3_256", "SHA3-384": "SHA_3_384", "SHA3-512": "SHA_3_512",
        "BLAKE2b-256": "BLAKE_2_B_256", "BLAKE2b-384": "BLAKE_2_B_384", "BLAKE2b-512": "BLAKE_2_B_512",
        "BLAKE3": "BLAKE_3",
    },
    "evidence_field": {"omniborId": "OMNIBOR_ID"},
}
# long spellings that mean "unset"
UNSET_LONG = ("NULL", "UNSPECIFIED")

SEVERITY_ORDER = "none info low medium high critical".split()
AGGREGATE_ORDER = (  # from least to most complete knowledge
    "not_specified unknown incomplete incomplete_first_party_only incomplete_third_party_only "
    "incomplete_first_party_proprietary_only incomplete_first_party_opensource_only "
    "incomplete_third_party_proprietary_only incomplete_third_party_opensource_only complete"
).split()
CLOSED_STATES = ("resolved", "resolved_with_pedigree", "false_positive", "not_affected")

# Anchored patterns of the model.
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
PATTERNS = {
    "hash": r"([a-fA-F0-9]{32})|([a-fA-F0-9]{40})|([a-fA-F0-9]{64})|([a-fA-F0-9]{96})|([a-fA-F0-9]{128})",
    "serial": rf"urn:uuid:({UUID})|(\{{{UUID}\}})",
    "link_document": rf"urn:cdx:{UUID}/[1-9][0-9]*",
    "link_element": rf"urn:cdx:{UUID}/[1-9][0-9]*#.+",
    "media_type": r"[-+a-z0-9.]+/[-+a-z0-9.]+",
    "locale": r"([a-z]{2})(-[A-Z]{2})?",
    "cre": r"CRE:[0-9]+-[0-9]+",
    "cpe": r"([c][pP][eE]:/[AHOaho]?(:[A-Za-z0-9\._\-~%]*){0,6})"
    r"|(cpe:2\.3:[aho\*\-](:(((\?*|\*?)([a-zA-Z0-9\-\._]|(\\[\\\*\?!\"#$%&'\(\)\+,/:;<=>@\[\]\^`\{\|}~]))+(\?*|\*?))|[\*\-])){5}"
    r"(:(([a-zA-Z]{2,3}(-([a-zA-Z]{2}|[0-9]{3}))?)|[\*\-]))"
    r"(:(((\?*|\*?)([a-zA-Z0-9\-\._]|(\\[\\\*\?!\"#$%&'\(\)\+,/:;<=>@\[\]\^`\{\|}~]))+(\?*|\*?))|[\*\-])){4})",
    "date_time": r"-?\d{4,}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?",
}


def anchored(name: str) -> str:
    return f"^(?:{PATTERNS[name]})$"

# Spec version in which an enum value first appears; values not
# listed are as old as the enum.
VALUE_SINCE = {
    "component_type": {
        "file": "1.1", "container": "1.2", "firmware": "1.2", "platform": "1.5", "device-driver": "1.5",
        "machine-learning-model": "1.5", "data": "1.5", "cryptographic-asset": "1.6",
    },
    "scope": {"excluded": "1.1"},
    "hash_alg": {
        "SHA3-384": "1.2", "BLAKE2b-256": "1.2", "BLAKE2b-384": "1.2", "BLAKE2b-512": "1.2", "BLAKE3": "1.2",
        "Streebog-256": "1.7", "Streebog-512": "1.7",
    },
    "aggregate": {
        "incomplete_first_party_proprietary_only": "1.5", "incomplete_first_party_opensource_only": "1.5",
        "incomplete_third_party_proprietary_only": "1.5", "incomplete_third_party_opensource_only": "1.5",
    },
    "reference_type": {
        "release-notes": "1.4", "source-distribution": "1.6", "electronic-signature": "1.6", "digital-signature": "1.6", "rfc-9116": "1.6",
        "patent": "1.7", "patent-family": "1.7", "patent-assertion": "1.7", "citation": "1.7",
        **dict.fromkeys(
            "distribution-intake security-contact model-card log configuration evidence formulation attestation threat-model "
            "adversary-model risk-assessment vulnerability-assertion exploitability-statement pentest-report static-analysis-report "
            "dynamic-analysis-report runtime-analysis-report component-analysis-report maturity-report certification-report "
            "quality-metrics codified-infrastructure poam".split(),
            "1.5",
        ),
    },
}

# Spec version in which a member of an element first appears.
MEMBER_SINCE = {
    "document": {
        "metadata": "1.2", "services": "1.2", "dependencies": "1.2", "externalReferences": "1.1", "compositions": "1.3",
        "properties": "1.3", "vulnerabilities": "1.4", "annotations": "1.5", "formulation": "1.5", "declarations": "1.6",
        "definitions": "1.6", "citations": "1.7",
    },
    "metadata": {"licenses": "1.3", "properties": "1.3", "lifecycles": "1.5", "manufacturer": "1.6", "distributionConstraints": "1.7"},
    "component": {
        "bom-ref": "1.1", "pedigree": "1.1", "externalReferences": "1.1", "evidence": "1.3", "properties": "1.3", "releaseNotes": "1.4",
        "modelCard": "1.5", "data": "1.5", "cryptoProperties": "1.6", "manufacturer": "1.6", "authors": "1.6", "tags": "1.6",
        "omniborId": "1.6", "swhid": "1.6", "versionRange": "1.7", "isExternal": "1.7", "patentAssertions": "1.7",
    },
    "service": {"properties": "1.3", "releaseNotes": "1.4", "trustZone": "1.5", "tags": "1.6", "patentAssertions": "1.7"},
}
