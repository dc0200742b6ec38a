"""Column functions of the model. Each is a composition of built-in
expressions, so it stays inside code generation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from ..model import enums as en

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _rank(col: Col, order: list[str]) -> Column:
    c, out = _c(col), None
    for i, v in enumerate(order):
        out = F.when(c == v, i) if out is None else out.when(c == v, i)
    return out


def enum_canonical(col: Col, enum: str) -> Column:
    """One spelling for an enum value: long upper-case names become the short
    document spelling, unset long values become null, others stay."""
    prefix, values, _ = en.ENUMS[enum]
    special = en.LONG_SPELLING.get(enum, {})
    pairs = {prefix + special.get(v, v.upper().replace("-", "_")): v for v in values}
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])
    c = F.trim(_c(col))
    unset = c.isin([prefix + u for u in en.UNSET_LONG] + [""])
    if enum == "severity":  # number 0 of this enum is a value that says "unknown"
        unset = c.isin("")
    return F.when(unset, F.lit(None)).otherwise(F.coalesce(F.try_element_at(lookup, c), c))


PURL = r"^pkg:/*([A-Za-z][A-Za-z0-9.+-]*)/(?:([^?#@]*)/)?([^/?#@]+)(?:@([^?#]*))?(?:\?([^#]*))?(?:#(.*))?$"


def purl_parts(col: Col) -> Column:
    c = _c(col)

    def part(i: int, decode: bool = True) -> Column:
        got = F.nullif(F.regexp_extract(c, PURL, i), F.lit(""))
        # '+' is a plain character in package urls, url_decode would make it a space
        return F.try_url_decode(F.replace(got, F.lit("+"), F.lit("%2B"))) if decode else got

    return F.when(
        c.rlike(PURL),
        F.struct(
            F.lower(part(1, False)).alias("type"),
            part(2).alias("namespace"),
            part(3).alias("name"),
            part(4).alias("version"),
            part(5, False).alias("qualifiers"),
            part(6).alias("subpath"),
        ),
    )


def purl_without_version(col: Col) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(col), r"[?#].*$", ""), r"@[^@/]*$", "")


CPE_FIELDS = ("part", "vendor", "product", "version", "update", "edition", "language")
CPE_MORE = ("sw_edition", "target_sw", "target_hw", "other")


def cpe_parts(col: Col) -> Column:
    """Fields of a 2.2 (``cpe:/``) or 2.3 name; ``\\:`` does not split."""
    c = _c(col)
    new = c.startswith("cpe:2.3:")
    body = F.when(new, c.substr(F.lit(9), F.length(c))).otherwise(F.regexp_replace(c, "^(?i)cpe:/", ""))
    parts = F.split(body, r"(?<!\\):")
    fields = [F.nullif(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(CPE_FIELDS)]
    fields += [F.when(new, F.get(parts, F.lit(i + len(CPE_FIELDS)))).alias(n) for i, n in enumerate(CPE_MORE)]
    form = F.when(new, "2.3").otherwise("2.2").alias("form")
    return F.when(c.rlike("^(?i)cpe:"), F.struct(form, *fields))


def bom_link_make(serial: Col, version: Col, ref: Col | None = None) -> Column:
    base = F.concat(F.lit("urn:cdx:"), serial_uuid(serial), F.lit("/"), _c(version).cast("string"))
    if ref is None:
        return base
    return F.when(_c(ref).isNull(), base).otherwise(F.concat(base, F.lit("#"), _c(ref)))


LINK = rf"^urn:cdx:({en.UUID})/([1-9][0-9]*)(?:#(.+))?$"


def bom_link_parts(col: Col) -> Column:
    c = _c(col)
    return F.when(
        c.rlike(LINK),
        F.struct(
            F.regexp_extract(c, LINK, 1).alias("uuid"),
            F.regexp_extract(c, LINK, 2).try_cast("int").alias("version"),
            F.nullif(F.regexp_extract(c, LINK, 3), F.lit("")).alias("ref"),
        ),
    )


def serial_uuid(col: Col) -> Column:
    return F.nullif(F.regexp_extract(_c(col), rf"^(?:urn:uuid:|\{{)({en.UUID})\}}?$", 1), F.lit(""))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


_VERSION = r"^[vV]?(\d+(?:\.\d+)*)[.\-_]?([^+]*)"


def version_key(col: Col) -> Column:
    """Sortable key ``struct<n array<struct<size int, digits string>>, p
    array<string>>``: numbers of any length as (digits, how many), trailing
    zeros removed, and an end mark (size -1 release, -2 pre-release), then the
    pre-release words, numbers led by their length. Null without a number."""
    c = F.trim(_c(col))

    def key(s: Column) -> Column:
        plain = lambda x: F.regexp_replace(x, r"^0+(?=[0-9])", "")
        sized = lambda x: F.struct(F.length(x).alias("size"), x.alias("digits"))
        nums = F.transform(F.split(F.regexp_replace(s["core"], r"(?:\.0+)+$", ""), r"\."), lambda x: sized(plain(x)))
        words = F.transform(
            F.regexp_extract_all(s["pre"], F.lit(r"([0-9]+|[a-z]+)"), 1),
            lambda w: F.when(w.rlike("^[0-9]"), F.concat(F.lpad(F.length(plain(w)).cast("string"), 10, "0"), plain(w))).otherwise(w),
        )
        end = F.array(F.struct(F.when(s["pre"] == "", F.lit(-1)).otherwise(F.lit(-2)).alias("size"), F.lit("").alias("digits")))
        return F.when(s["core"] != "", F.struct(F.concat(nums, end).alias("n"), words.alias("p")))

    cut = F.struct(
        F.regexp_extract(c, _VERSION, 1).alias("core"), F.lower(F.regexp_extract(c, _VERSION, 2)).alias("pre")
    )
    return let(cut, key)


KNOWN_SCHEMES = ("generic", "semver")
CONSTRAINT = r"^\s*(>=|<=|!=|<|>|=)?\s*(.*?)\s*$"


def vers_constraints(col: Col) -> Column:
    """``struct<scheme, constraints array<struct<op, version>>>`` of a range text."""
    c = F.trim(_c(col))
    scheme = F.lower(F.regexp_extract(c, r"^vers:([A-Za-z0-9.+-]+)/", 1))
    parts = F.split(F.regexp_replace(c, r"^vers:[A-Za-z0-9.+-]+/", ""), r"\|")
    items = F.transform(
        parts,
        lambda p: F.struct(
            F.coalesce(F.nullif(F.regexp_extract(p, CONSTRAINT, 1), F.lit("")), F.lit("=")).alias("op"),
            F.try_url_decode(F.replace(F.regexp_extract(p, CONSTRAINT, 2), F.lit("+"), F.lit("%2B"))).alias("version"),
        ),
    )
    kept = F.filter(items, lambda x: x["version"] != "")
    return F.when(c.rlike(r"^vers:[A-Za-z0-9.+-]+/"), F.struct(scheme.alias("scheme"), kept.alias("constraints")))


def range_compiled(col: Col, schemes: tuple[str, ...] = KNOWN_SCHEMES) -> Column:
    """A range as data, computed once per range row: points, excluded points
    and intervals in version-key form. Null for schemes without a known order.

    Equal and bare constraints are points, ``!=`` excludes, the other
    comparators sorted by version pair a lower bound with the next upper one;
    ``*`` matches everything."""
    lower = (">", ">=")

    def with_key(x: Column) -> Column:
        return F.struct(version_key(x["version"]).alias("k"), x["op"].alias("op"), x["version"].alias("v"))

    def intervals_of(bounds: Column) -> Column:
        def interval(x: Column, i: Column) -> Column:
            prev = F.get(bounds, i - 1)
            upper_here = ~x["op"].isin(*lower)
            usable_prev = (i > 0) & prev["op"].isin(*lower)
            paired = F.struct(
                F.when(usable_prev, prev["k"]).alias("lo"),
                F.coalesce(usable_prev & (prev["op"] == ">="), F.lit(False)).alias("lo_in"),
                x["k"].alias("hi"), (x["op"] == "<=").alias("hi_in"),
            )
            open_end = F.struct(
                x["k"].alias("lo"), (x["op"] == ">=").alias("lo_in"),
                F.when(F.lit(False), x["k"]).alias("hi"), F.lit(False).alias("hi_in"),
            )
            return F.when(upper_here & ((i == 0) | usable_prev), paired).when(
                ~upper_here & (i == F.size(bounds) - 1), open_end
            )

        return F.filter(F.transform(bounds, interval), lambda x: x.isNotNull())

    def compiled(cons: Column) -> Column:
        eq = (lambda x: (x["op"] == "=") & (x["v"] != "*"))
        ordered = F.array_sort(F.filter(cons, lambda x: ~x["op"].isin("=", "!=")))
        bad = F.exists(cons, lambda x: x["k"].isNull() & (x["v"] != "*"))
        return F.when(
            ~bad,
            F.struct(
                F.exists(cons, lambda x: (x["v"] == "*") & (x["op"] == "=")).alias("everything"),
                F.transform(F.filter(cons, eq), lambda x: x["k"]).alias("points"),
                F.transform(F.filter(cons, lambda x: x["op"] == "!="), lambda x: x["k"]).alias("excluded"),
                let(ordered, intervals_of).alias("intervals"),
            ),
        )

    return let(
        vers_constraints(col),
        lambda v: F.when(v["scheme"].isin(*schemes), let(F.transform(v["constraints"], with_key), compiled)),
    )


def key_in_compiled(key: Column, rng: Column) -> Column:
    """Is a ``version_key`` inside a ``range_compiled``? Null when either is."""
    hit = F.exists(
        rng["intervals"],
        lambda i: (i["lo"].isNull() | (key > i["lo"]) | (i["lo_in"] & (key == i["lo"])))
        & (i["hi"].isNull() | (key < i["hi"]) | (i["hi_in"] & (key == i["hi"]))),
    )
    only_excluded = (F.size(rng["points"]) == 0) & (F.size(rng["intervals"]) == 0) & (F.size(rng["excluded"]) > 0)
    inside = rng["everything"] | only_excluded | F.exists(rng["points"], lambda p: p == key) | hit
    out = F.exists(rng["excluded"], lambda p: p == key)
    return F.when(key.isNotNull() & rng.isNotNull(), inside & ~out)


def in_range(version: Col, rng: Col, schemes: tuple[str, ...] = KNOWN_SCHEMES) -> Column:
    both = F.struct(version_key(version).alias("k"), range_compiled(rng, schemes).alias("r"))
    return let(both, lambda x: key_in_compiled(x["k"], x["r"]))


def severity_rank(col: Col) -> Column:
    return _rank(col, en.SEVERITY_ORDER)


def tlp_rank(col: Col) -> Column:
    return _rank(col, en.TLP)


def aggregate_rank(col: Col) -> Column:
    return _rank(col, en.AGGREGATE_ORDER)


def proto_ts(seconds: Col, nanos: Col) -> Column:
    return F.timestamp_micros(_c(seconds).cast("bigint") * 1_000_000 + F.floor(F.coalesce(_c(nanos), F.lit(0)) / 1000).cast("bigint"))


def norm_hash(col: Col) -> Column:
    c = F.lower(F.trim(_c(col)))
    return F.struct(c.alias("value"), F.length(c).alias("digits"))


def license_tokens(col: Col) -> Column:
    """Ids named in an expression, without operators and parentheses."""
    found = F.regexp_extract_all(_c(col), F.lit(r"([A-Za-z0-9.+:_-]+)"), 1)
    return F.array_distinct(F.filter(found, lambda t: ~F.upper(t).isin("AND", "OR", "WITH")))


def gitoid_parts(col: Col) -> Column:
    p = F.split(_c(col), ":")
    return F.when(
        _c(col).startswith("gitoid:"),
        F.struct(p[0].alias("scheme"), F.get(p, F.lit(1)).alias("object_type"), F.get(p, F.lit(2)).alias("hash_alg"),
                 F.get(p, F.lit(3)).alias("digest")),
    )


def swhid_parts(col: Col) -> Column:
    p = F.split(F.split(_c(col), ";")[0], ":")
    return F.when(
        _c(col).startswith("swh:"),
        F.struct(p[0].alias("scheme"), F.get(p, F.lit(1)).try_cast("int").alias("scheme_version"),
                 F.get(p, F.lit(2)).alias("object_type"), F.get(p, F.lit(3)).alias("digest")),
    )


def pointer_path(pointer: str) -> str:
    """JSON pointer text to the path syntax of ``variant_get``."""
    out = "$"
    for raw in pointer.split("/")[1:]:
        key = raw.replace("~1", "/").replace("~0", "~")
        out += f"[{key}]" if key.isdigit() else "['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return out


def json_pointer_get(doc: Col, pointer: str, type_: str = "string") -> Column:
    """Value at a constant pointer of a variant column, null if absent."""
    return F.try_variant_get(_c(doc), pointer_path(pointer), type_)


def net_co2(cost: Col, offset: Col) -> Column:
    """Cost minus offset; a missing offset counts as none, a missing cost stays unknown."""
    return _c(cost) - F.coalesce(_c(offset), F.lit(0.0))


def cert_state_at(
    at: Col, not_before: Col, not_after: Col, revoked: Col | None = None, destroyed: Col | None = None,
    deactivated: Col | None = None,
) -> Column:
    a = _c(at)
    passed = lambda x: F.lit(False) if x is None else F.coalesce(_c(x) <= a, F.lit(False))
    return (
        F.when(passed(destroyed), "destroyed")
        .when(passed(revoked), "revoked")
        .when(passed(deactivated), "deactivated")
        .when(a < _c(not_before), "pre-activation")
        .when(a > _c(not_after), "deactivated")
        .otherwise("active")
    )


def content_hash(*cols: Col) -> Column:
    """Digest of the named values; keys in a fixed order, nulls left out."""
    named = [c if isinstance(c, str) else None for c in cols]
    parts = [F.col(n) for n in sorted(named)] if all(named) else [_c(c) for c in cols]
    return F.sha2(F.to_json(F.struct(*parts)), 256)
