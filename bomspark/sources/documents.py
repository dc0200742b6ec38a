"""Readers and writers of documents.

A document frame has ``bom_id, source_path, format, content, doc``. ``doc`` is
the typed view of the text; the optimizer prunes it to the members a query
touches. ``content`` stays, so a document can be written back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..model import doc_schema as D

# Conventional file names of documents.
JSON_GLOB = "{bom.json,*.cdx.json}"
XML_GLOB = "{bom.xml,*.cdx.xml}"


def _with_id(raw: DataFrame, fmt: str) -> DataFrame:
    bom_id = F.sha2(F.concat_ws("\u0000", "source_path", "content"), 256)
    return raw.select(bom_id.alias("bom_id"), "source_path", F.lit(fmt).alias("format"), "content")


def typed(docs: DataFrame) -> DataFrame:
    """Add the typed view to a frame with ``content``."""
    return docs.withColumn("doc", F.from_json("content", D.DOCUMENT))


def read_bom_json(spark: SparkSession, path: str, glob: str | None = JSON_GLOB) -> DataFrame:
    """One row per file. Whole files do not split; for large corpora use
    :func:`read_bom_jsonl` or Parquet."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("content")
    )
    docs = _with_id(raw, "json")
    return typed(docs).withColumn("variant", F.try_parse_json("content"))


def read_bom_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One document per line; files split across tasks."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("content")
    ).filter("length(trim(content)) > 0")
    return typed(_with_id(raw, "json"))


def stream_bom_files(spark: SparkSession, path: str, max_files: int = 1000, lines: bool = True) -> DataFrame:
    """Documents as files arrive in a folder."""
    reader = spark.readStream.option("maxFilesPerTrigger", str(max_files))
    if not lines:
        reader = reader.option("wholetext", "true")
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("content")
    )
    return typed(_with_id(raw, "json"))


# The spec version is the last path step of the XML namespace and
# part of the schema name of a JSON document.
_NS_VERSION = r"/schema/bom/(\d+\.\d+)$"
_SCHEMA_VERSION = r"/bom-(\d+\.\d+)\.schema\.json$"
_PATH_VERSION = r"[/-](\d+\.\d+)(?:\.(?:cdx\.)?(?:json|xml|textproto)$|/[^/]*$)"


def detect_format(raw: DataFrame, known: list[str] | None = None) -> DataFrame:
    """Format and spec version of ``raw(source_path, content)`` by each sign,
    and whether the signs agree."""
    known = known or [f"1.{i}" for i in range(8)]
    text = F.ltrim("content")
    fmt = F.when(text.startswith("{"), "json").when(text.startswith("<"), "xml").otherwise("unknown")
    pick = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    json_of = lambda path: F.get_json_object("content", path)
    root = F.regexp_extract("content", r"<(?:[\w.-]+:)?bom\b([^>]*)>", 1)
    namespace = F.regexp_extract(root, r"xmlns(?::[\w.-]+)?\s*=\s*[\"']([^\"']*/schema/bom/[^\"']*)[\"']", 1)
    by_content = F.when(fmt == "json", json_of("$.specVersion")).when(fmt == "xml", pick(namespace, _NS_VERSION))
    by_schema = F.when(fmt == "json", pick(json_of("$['$schema']"), _SCHEMA_VERSION))
    by_path = pick("source_path", _PATH_VERSION)
    out = raw.select(
        "source_path", fmt.alias("format"), by_content.alias("spec_version"), by_schema.alias("schema_version"),
        by_path.alias("path_version"),
    )
    signs = F.array_compact(F.array("spec_version", "schema_version", "path_version"))
    return out.withColumn("agree", F.size(F.array_distinct(signs)) <= 1).withColumn(
        "known", F.coalesce(F.col("spec_version").isin(known), F.lit(False))
    )


def quarantine_corrupt(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, unreadable) documents."""
    if "_corrupt_record" in docs.columns:
        bad = F.col("_corrupt_record").isNotNull()
    else:
        bad = F.try_parse_json("content").isNull() | ~F.ltrim("content").startswith("{")
    return docs.filter(~bad), docs.filter(bad)


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Parquet per table, by spec version where the table has one."""
    for name, df in tables.items():
        writer = df.write.mode(mode)
        if "spec_version" in df.columns:
            writer = writer.partitionBy("spec_version")
        writer.parquet(f"{path}/{name}")


def json_array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def json_object(**members: Column) -> Column:
    """JSON object text from members that are JSON text; null members are left
    out. A trailing ``_`` and ``__`` in names stand for nothing and ``-``."""
    parts = [
        F.concat(F.lit('"' + k.strip("_").replace("__", "-") + '":'), v) for k, v in members.items()
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def quoted(value: Column) -> Column:
    """A value as JSON text (null stays null)."""
    wrapped = F.to_json(F.struct(value.alias("v")))  # {"v":...}
    return F.when(value.isNotNull(), wrapped.substr(F.lit(6), F.length(wrapped) - 6))


def bom_documents(
    boms: DataFrame, components: DataFrame, edges: DataFrame | None = None, bom_format: str | None = None,
) -> DataFrame:
    """Rebuild documents from tables: ``bom_id, content``. A document is one
    row with all its elements, however many there are."""
    c = components
    cols = [
        ("type", "type"), ("bom-ref", "bom_ref"), ("group", "comp_group"), ("name", "name"), ("version", "version"),
        ("scope", "scope"), ("purl", "purl"), ("isExternal", "is_external"),
    ]
    fields = [F.col(src).alias(dst) for dst, src in cols if src in c.columns]
    if "license_id" in c.columns:
        fields.append(
            F.when(F.col("license_id").isNotNull(), F.array(F.struct(F.struct(F.col("license_id").alias("id")).alias("license")))).alias("licenses")
        )
    if "hash_md5" in c.columns:
        fields.append(
            F.when(F.col("hash_md5").isNotNull(), F.array(F.struct(F.lit("MD5").alias("alg"), F.col("hash_md5").alias("content")))).alias("hashes")
        )
    items = c.select("bom_id", F.lit("c").alias("kind"), F.col("bom_ref").alias("ord"), F.to_json(F.struct(*fields)).alias("item"))
    if edges is not None:
        per_ref = edges.groupBy("bom_id", "ref").agg(F.array_sort(F.collect_set("target")).alias("dependsOn"))
        items = items.unionByName(
            per_ref.select(
                "bom_id", F.lit("d").alias("kind"), F.col("ref").alias("ord"),
                F.to_json(F.struct("ref", "dependsOn")).alias("item"),
            )
        )

    def gathered(kind: str) -> Column:
        lst = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "item"))))
        return F.transform(lst, lambda x: x["item"])

    parts = items.groupBy("bom_id").agg(gathered("c").alias("_c"), gathered("d").alias("_d"))
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    meta = F.to_json(
        F.struct(
            stamp.alias("timestamp"), F.array(F.struct(F.col("lifecycle_phase").alias("phase"))).alias("lifecycles"),
            F.struct("tlp").alias("distributionConstraints"),
        )
    )
    head = {
        "bomFormat": F.lit(None).cast("string") if bom_format is None else quoted(F.lit(bom_format)),
        "specVersion": quoted(F.col("spec_version")), "serialNumber": quoted(F.col("serial_number")),
        "version": F.col("version").cast("string"), "metadata": meta,
    }
    some = lambda a: F.when(F.size(a) > 0, json_array(F.col(a)))
    content = json_object(**head, components=json_array(F.coalesce("_c", F.array().cast("array<string>"))), dependencies=some("_d"))
    return boms.join(parts, "bom_id", "left").select("bom_id", content.alias("content"))


def write_bom_json(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One document per line, in gzip files: texts of documents repeat their member names."""
    documents.select("content").write.mode(mode).option("compression", "gzip").text(path)


def field_projection(docs: DataFrame, pointers: dict[str, tuple[str, str]]) -> DataFrame:
    """Chosen pointers of a corpus as columns: ``name -> (pointer, type)``."""
    v = docs.select("bom_id", F.try_parse_json("content").alias("_v"))
    return v.select("bom_id", *[S.json_pointer_get("_v", p, ty).alias(n) for n, (p, ty) in pointers.items()])


def document_hash(docs: DataFrame) -> DataFrame:
    """Digest of a normalized document: the variant form orders keys, so the
    text layout does not matter."""
    return docs.withColumn("content_hash", F.sha2(F.to_json(F.try_parse_json("content")), 256))
