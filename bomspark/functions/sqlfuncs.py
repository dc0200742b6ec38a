"""SQL names for the column functions. They are SQL functions with an
expression body, so the optimizer inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..model import enums as en
from . import scalars as S


def _case(order: list[str], arg: str) -> str:
    return "CASE " + " ".join(f"WHEN {arg} = '{v}' THEN {i}" for i, v in enumerate(order)) + " END"


_UUID = en.UUID
BODIES: dict[str, tuple[str, str, str]] = {
    # name: (parameters, return type, body)
    "severity_rank": ("s STRING", "INT", _case(en.SEVERITY_ORDER, "s")),
    "tlp_rank": ("s STRING", "INT", _case(en.TLP, "s")),
    "aggregate_rank": ("s STRING", "INT", _case(en.AGGREGATE_ORDER, "s")),
    "purl_without_version": ("p STRING", "STRING", "regexp_replace(regexp_replace(p, '[?#].*$', ''), '@[^@/]*$', '')"),
    "purl_version": ("p STRING", "STRING", "nullif(regexp_extract(regexp_replace(p, '[?#].*$', ''), '@([^@/]*)$', 1), '')"),
    "serial_uuid": ("s STRING", "STRING", f"nullif(regexp_extract(s, '^(?:urn:uuid:|[{{])({_UUID})[}}]?$', 1), '')"),
    "norm_hash": ("h STRING", "STRING", "lower(trim(h))"),
    "net_co2": ("cost DOUBLE, off DOUBLE", "DOUBLE", "cost - coalesce(off, 0.0D)"),
    "proto_ts": (
        "s BIGINT, n BIGINT", "TIMESTAMP", "timestamp_micros(s * 1000000 + CAST(floor(coalesce(n, 0) / 1000) AS BIGINT))",
    ),
    "bom_link_make": (
        "serial STRING, version INT, ref STRING", "STRING",
        "concat('urn:cdx:', serial_uuid(serial), '/', CAST(version AS STRING), "
        "CASE WHEN ref IS NULL THEN '' ELSE concat('#', ref) END)",
    ),
    "bom_link_uuid": ("l STRING", "STRING", f"nullif(regexp_extract(l, '^urn:cdx:({_UUID})/[1-9][0-9]*(?:#.+)?$', 1), '')"),
    "license_tokens": (
        "e STRING", "ARRAY<STRING>",
        "array_distinct(filter(regexp_extract_all(e, '([A-Za-z0-9.+:_-]+)', 1), t -> upper(t) NOT IN ('AND', 'OR', 'WITH')))",
    ),
    "version_numbers": (
        "v STRING", "ARRAY<BIGINT>",
        "transform(split(regexp_extract(v, '^[vV]?([0-9]+(?:[.][0-9]+)*)', 1), '[.]'), x -> try_cast(x AS BIGINT))",
    ),
    "noisy_or": (
        "cs ARRAY<DOUBLE>", "DOUBLE",
        "aggregate(cs, CAST(1.0 AS DOUBLE), (a, c) -> a * (1.0D - least(greatest(c, 0.0D), 1.0D)), a -> 1.0D - a)",
    ),
}


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _match(text: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({text}, r'{pattern}', {group}), '')"


def _canonical() -> str:
    """Spelling of a value by the name of its enum; the tables have fixed size."""
    branches = []
    for enum, (prefix, values, _) in en.ENUMS.items():
        special = en.LONG_SPELLING.get(enum, {})
        pairs = ", ".join(f"'{prefix}{special.get(v, v.upper().replace('-', '_'))}', '{v}'" for v in values)
        unset = [""] if enum == "severity" else [*(prefix + u for u in en.UNSET_LONG), ""]
        branches.append(f"WHEN '{enum}' THEN CASE WHEN trim(v) IN ({', '.join(repr(u) for u in unset)}) THEN NULL ELSE coalesce(try_element_at(map({pairs}), trim(v)), trim(v)) END")
    return f"CASE e {' '.join(branches)} END"


def _purl() -> str:
    plain = lambda i: _match("p", S.PURL, i)
    decoded = lambda i: f"try_url_decode(replace({plain(i)}, '+', '%2B'))"
    fields = {"type": f"lower({plain(1)})", "namespace": decoded(2), "name": decoded(3), "version": decoded(4), "qualifiers": plain(5), "subpath": decoded(6)}
    return f"CASE WHEN p RLIKE r'{S.PURL}' THEN {_struct(fields)} END"


def _cpe() -> str:
    body = "CASE WHEN startswith(c, 'cpe:2.3:') THEN substr(c, 9) ELSE regexp_replace(c, '^(?i)cpe:/', '') END"
    part = lambda i: f"get(split({body}, r'(?<!\\\\):'), {i})"
    fields = {"form": "CASE WHEN startswith(c, 'cpe:2.3:') THEN '2.3' ELSE '2.2' END"}
    fields |= {n: f"nullif({part(i)}, '')" for i, n in enumerate(S.CPE_FIELDS)}
    fields |= {n: f"CASE WHEN startswith(c, 'cpe:2.3:') THEN {part(i + len(S.CPE_FIELDS))} END" for i, n in enumerate(S.CPE_MORE)}
    return f"CASE WHEN c RLIKE '^(?i)cpe:' THEN {_struct(fields)} END"


def _texts(*names: str) -> str:
    return ", ".join(f"{n} STRING" for n in names)


_PASSED = "coalesce({} <= at, false)"
BODIES |= {
    "enum_canonical": ("v STRING, e STRING", "STRING", _canonical()),
    "purl_parts": ("p STRING", f"STRUCT<{_texts('type', 'namespace', 'name', 'version', 'qualifiers', 'subpath')}>", _purl()),
    "cpe_parts": ("c STRING", f"STRUCT<{_texts('form', *S.CPE_FIELDS, *S.CPE_MORE)}>", _cpe()),
    "bom_link_parts": (
        "l STRING", "STRUCT<uuid STRING, version INT, ref STRING>",
        f"CASE WHEN l RLIKE r'{S.LINK}' THEN " + _struct({"uuid": _match("l", S.LINK, 1), "version": f"try_cast({_match('l', S.LINK, 2)} AS INT)", "ref": _match("l", S.LINK, 3)}) + " END",
    ),
    "gitoid_parts": (
        "g STRING", f"STRUCT<{_texts('scheme', 'object_type', 'hash_alg', 'digest')}>",
        "CASE WHEN startswith(g, 'gitoid:') THEN " + _struct({n: f"get(split(g, ':'), {i})" for i, n in enumerate(("scheme", "object_type", "hash_alg", "digest"))}) + " END",
    ),
    "swhid_parts": (
        "w STRING", "STRUCT<scheme STRING, scheme_version INT, object_type STRING, digest STRING>",
        "CASE WHEN startswith(w, 'swh:') THEN " + _struct({
            n: f"try_cast(get(split(split(w, ';')[0], ':'), {i}) AS {'INT' if i == 1 else 'STRING'})" for i, n in enumerate(("scheme", "scheme_version", "object_type", "digest"))
        }) + " END",
    ),
    "cert_state_at": (
        "at TIMESTAMP, not_before TIMESTAMP, not_after TIMESTAMP, revoked TIMESTAMP, destroyed TIMESTAMP, deactivated TIMESTAMP", "STRING",
        "CASE " + " ".join(f"WHEN {_PASSED.format(n)} THEN '{n}'" for n in ("destroyed", "revoked", "deactivated"))
        + " WHEN at < not_before THEN 'pre-activation' WHEN at > not_after THEN 'deactivated' ELSE 'active' END",
    ),
    "vers_constraints": (
        "r STRING", "STRUCT<scheme STRING, constraints ARRAY<STRUCT<op STRING, version STRING>>>",
        "CASE WHEN trim(r) RLIKE '^vers:[A-Za-z0-9.+-]+/' THEN named_struct('scheme', lower(regexp_extract(trim(r), '^vers:([A-Za-z0-9.+-]+)/', 1)), 'constraints', "
        "filter(transform(split(regexp_replace(trim(r), '^vers:[A-Za-z0-9.+-]+/', ''), '[|]'), x -> named_struct("
        f"'op', coalesce({_match('x', S.CONSTRAINT, 1)}, '='), "
        f"'version', try_url_decode(replace(regexp_extract(x, r'{S.CONSTRAINT}', 2), '+', '%2B')))), y -> y.version <> '')) END",
    ),
    "content_hash": ("v VARIANT", "STRING", "sha2(to_json(v), 256)"),
}


def register_functions(spark: SparkSession) -> list[str]:
    for name, (params, returns, body) in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
    return sorted(BODIES)
