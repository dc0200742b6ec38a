"""Text jobs. Whole texts are scanned by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Wording that names a license in running text.
LICENSE_WORDING = [
    ("Apache-2.0", r"Apache License, Version 2\.0"),
    ("MIT", r"MIT License"),
    ("GPL-3.0-only", r"GNU General Public License, version 3"),
    ("CC-BY-NC-4.0", r"CC BY-NC 4\.0"),
]
COPYRIGHT = r"(?i)((?:copyright|\(c\)|©)[^\n]*)"


def observe_licenses(texts: DataFrame, wording: list[tuple[str, str]] = LICENSE_WORDING) -> DataFrame:
    """(doc_id, license_id): every license a text names."""
    hits = F.array(*[F.when(F.col("text").rlike(p), F.lit(i)) for i, p in wording])
    return texts.select("doc_id", F.explode(F.array_compact(hits)).alias("license_id"))


# Wordings in use that are neither ids nor names of a list.
LICENSE_ALIASES = [
    ("BSD", "BSD License"), ("BSD", "BSD-style license"), ("BSD-2-Clause", "Simplified BSD License"), ("BSD-3-Clause", "New BSD License"),
    ("BSD-3-Clause", "Modified BSD License"), ("MIT", "Expat License"),
]
#: Words without weight in a license's name.
_FILLERS = ("the", "version", "v")


def license_tokens(text: Column) -> Column:
    """Words of a wording in one spelling: lower case, ``v3`` as ``3``,
    without fillers, ``licence`` as ``license``."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    words = F.filter(words, lambda w: ~w.isin(*_FILLERS))
    return F.transform(words, lambda w: F.when(w == "licence", "license").when(w.rlike("^v[0-9]+$"), F.substr(w, F.lit(2))).otherwise(w))


def license_phrases(licenses: DataFrame, aliases: list[tuple[str, str]] = LICENSE_ALIASES) -> DataFrame:
    """``phrase, license_id, head``: what running text may call the licenses of
    a list ``(license_id, name)``.

    A license goes by its id, its name, both without ``only`` and without the
    ``.0`` of a version, and by its glued short form (``GPLv3``, ``GPL3``). One
    word without a digit is a name only beside the word license, or behind
    ``identifier``. A phrase of several licenses is that of the one it is spelled
    out for, ties to the smaller id. Null ids give nothing, null names no phrase.
    ``head`` is the first word of a single-word phrase, else the first two."""
    spark = licenses.sparkSession
    listed = licenses.filter("license_id IS NOT NULL").select("license_id", F.explode(F.array("license_id", "name")).alias("w"))
    named = listed.unionByName(spark.createDataFrame(aliases, "license_id string, w string")).select(
        "license_id", F.array_join(license_tokens(F.col("w")), " ").alias("p")
    ).filter("p <> ''")
    cut_at = lambda c, pattern, to: F.regexp_replace(c, pattern, to)
    p = F.col("p")
    short = cut_at(p, " only$", "")
    rounded = cut_at(cut_at(p, "^(.*[0-9]) 0( only| or later)?$", "$1$2"), " only$", "")
    glued = "^([a-z]+) ([0-9]+)(?: 0)?(?: only)?$"
    forms = F.array(
        F.struct(F.lit(0).alias("rank"), p.alias("phrase")), F.struct(F.lit(1).alias("rank"), short.alias("phrase")),
        F.struct(F.lit(1).alias("rank"), rounded.alias("phrase")),
        *[F.struct(F.lit(2).alias("rank"), F.when(p.rlike(glued), cut_at(p, glued, to)).alias("phrase")) for to in ("$1v$2", "$1$2")],
    )
    flat = named.select("license_id", F.inline(forms)).filter("phrase IS NOT NULL")
    bare = ~F.col("phrase").contains(" ") & ~F.col("phrase").rlike("[0-9]")
    word = F.col("phrase")
    spelled = F.when(bare, F.array(F.concat(word, F.lit(" license")), F.concat(F.lit("license "), word), F.concat(F.lit("identifier "), word))).otherwise(F.array(word))
    phrases = flat.filter("phrase <> 'license'").select("license_id", "rank", F.explode(spelled).alias("phrase"))
    one = phrases.groupBy("phrase").agg(F.min(F.struct("rank", "license_id"))["license_id"].alias("license_id"))
    return one.withColumn("head", F.substring_index("phrase", " ", 2))


def observe_listed_licenses(texts: DataFrame, licenses: DataFrame, aliases: list[tuple[str, str]] = LICENSE_ALIASES) -> DataFrame:
    """(doc_id, license_id): every license of a list that a text names, once.

    Whole texts are read in one pass. Each place gives its first word (where it
    holds a digit) and its first two as keys to the phrases; the join is left to
    the measured sizes, and only places where a phrase begins meet one. Of the
    phrases that begin at a place the longest counts. Null and empty texts give
    no row, rows that repeat a doc_id are read together."""
    phrases = license_phrases(licenses, aliases)
    longest = phrases.agg(F.coalesce(F.max(F.size(F.split("phrase", " "))), F.lit(1))).scalar()
    places = F.transform(
        F.sequence(F.lit(1), F.size("w")),
        lambda i: F.struct(i.alias("place"), F.array_join(F.slice("w", i, F.col("_longest")), " ").alias("window")),
    )
    words = texts.select("doc_id", license_tokens(F.col("text")).alias("w"), longest.alias("_longest")).filter("size(w) > 0")
    at = words.select("doc_id", F.inline(places))
    first = F.substring_index("window", " ", 1)
    heads = F.array_distinct(F.array(F.substring_index("window", " ", 2), F.when(first.rlike("[0-9]"), first)))
    keyed = at.select("doc_id", "place", "window", F.explode(F.array_compact(heads)).alias("head"))
    found = keyed.join(phrases, "head").filter(F.concat("window", F.lit(" ")).startswith(F.concat("phrase", F.lit(" "))))
    best = found.groupBy("doc_id", "place").agg(F.max_by("license_id", F.struct(F.length("phrase"), "license_id")).alias("license_id"))
    return best.select("doc_id", "license_id").distinct()


def extract_copyright(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(COPYRIGHT), 1)).alias("position", "statement")).withColumn(
        "statement", F.trim("statement")
    )


def decode_attachments(attachments: DataFrame) -> DataFrame:
    """Base64 or plain attachment text -> bytes, size, and the text where the
    bytes are UTF-8 (null for images and the like). Broken base64 keeps its
    row with ``valid`` false and nulls."""
    raw = F.when(F.col("encoding") == "base64", F.try_to_binary("content", F.lit("base64"))).otherwise(F.encode("content", "UTF-8"))
    return attachments.withColumn("raw", raw).select(
        *[c for c in attachments.columns if c != "content"], "raw", F.try_validate_utf8(F.col("raw").cast("string")).alias("text"),
        F.octet_length("raw").alias("n_bytes"), (F.col("content").isNull() | F.col("raw").isNotNull()).alias("valid"),
    )


def extract_urls(references: DataFrame) -> DataFrame:
    """Number of references and pages per scheme and host."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    scheme = F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return references.select(scheme.alias("scheme"), host.alias("host")).groupBy("scheme", "host").agg(F.count("*").alias("n"))
