"""Corpus upgrades: members of older documents in the shape of newer ones.
Each job is a projection; no row moves between tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..model import doc_schema as D

_TOOL = f"struct<vendor string, name string, version string, hashes {D.HASHES}, externalReferences {D.EXTERNAL_REFERENCES}>"


def upgrade_tools(docs: DataFrame) -> DataFrame:
    """``tools``: list of tools -> object with components and services. The
    vendor becomes the supplier. An object stays as it is."""
    v = F.col("doc.metadata.tools")
    old = F.try_variant_get(v, "$", f"array<{_TOOL}>")
    new = F.to_json(F.struct(
        F.transform(old, lambda t: F.struct(
            F.lit("application").alias("type"), F.when(t["vendor"].isNotNull(), F.struct(t["vendor"].alias("name"))).alias("supplier"),
            t["name"].alias("name"), t["version"].alias("version"), t["hashes"].alias("hashes"), t["externalReferences"].alias("externalReferences"),
        )).alias("components"),
        F.array().cast("array<string>").alias("services"),
    ))
    tools = F.when(old.isNotNull(), F.parse_json(new)).otherwise(v)
    return docs.withColumn("doc", F.col("doc").withField("metadata", F.when(
        F.col("doc.metadata").isNotNull(), F.col("doc.metadata").withField("tools", tools))))


def upgrade_data_flow(records: DataFrame, column: str = "data") -> DataFrame:
    """(flow, value) classification records -> data flow entries."""
    none = F.lit(None)
    flows = F.transform(column, lambda r: F.struct(
        r["flow"].alias("flow"), r["value"].alias("classification"), none.cast("string").alias("name"), none.cast("string").alias("description"),
        none.cast("array<string>").alias("source"), none.cast("array<string>").alias("destination"),
    ))
    return records.withColumn(column, flows)


def upgrade_cardinality(df: DataFrame, to_one: tuple[str, ...] = (), to_list: tuple[str, ...] = ()) -> DataFrame:
    """List -> one entry, single -> list of one; nothing stays nothing.

    The entries of a list become one: their lists end to end, of single members
    the first that is there. Entries without members are joined as lists are,
    or else stay apart, in ``<name>_more``, all but the first."""
    for c in to_one:
        kind = df.schema[c].dataType.elementType
        entries = F.filter(c, lambda x: x.isNotNull())
        if isinstance(kind, T.StructType):
            none = lambda f: F.lit(None).cast(f.dataType)

            def member(f: T.StructField, entries=entries, none=none) -> Column:
                got = F.filter(F.transform(entries, lambda x: x[f.name]), lambda x: x.isNotNull())
                whole = F.flatten(got) if isinstance(f.dataType, T.ArrayType) else F.get(got, F.lit(0))
                return F.when(F.size(got) > 0, whole).otherwise(none(f)).alias(f.name)

            one = F.struct(*[member(f) for f in kind.fields])
        elif isinstance(kind, T.ArrayType):
            one = F.flatten(entries)
        else:
            df = df.withColumn(f"{c}_more", F.slice(entries, F.lit(2), F.greatest(F.size(entries) - 1, F.lit(0))))
            one = F.get(entries, F.lit(0))
        df = df.withColumn(c, F.when(F.size(entries) > 0, one))
    for c in to_list:
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.array(c)))
    return df


def upgrade_author(elements: DataFrame) -> DataFrame:
    """``author`` text -> ``authors`` list, kept where a list is there already."""
    c = F.col("c")
    contact = F.struct(*[(c["author"] if n == "name" else F.lit(None).cast("string")).alias(n) for n in ("bom-ref", "name", "email", "phone")])
    authors = F.coalesce(c["authors"], F.when(c["author"].isNotNull(), F.array(contact)))
    return elements.withColumn("c", c.withField("authors", authors).withField("author", F.lit(None).cast("string")))


def upgrade_manufacture(docs: DataFrame) -> DataFrame:
    """``metadata.manufacture`` -> ``metadata.manufacturer``."""
    m = F.col("doc.metadata")
    new = m.withField("manufacturer", F.coalesce(m["manufacturer"], m["manufacture"])).withField(
        "manufacture", F.lit(None).cast(D.ORGANIZATION))
    return docs.withColumn("doc", F.col("doc").withField("metadata", F.when(m.isNotNull(), new)))


def _with_assets(owner: Column, *refs: tuple[str, Column]) -> Column:
    none = F.array().cast(D.RELATED_ASSETS)
    moved = [F.when(r.isNotNull(), F.array(F.struct(F.lit(t).alias("type"), r.alias("ref")))) for t, r in refs]
    return F.array_union(F.coalesce(owner["relatedCryptographicAssets"], none), F.concat(*[F.coalesce(m, none) for m in moved]))


def upgrade_crypto(assets: DataFrame, column: str = "p") -> DataFrame:
    """Old members of crypto properties to their successors; the successor wins
    where both are given."""
    p = F.col(column)
    text = F.lit(None).cast("string")
    al, ce, ma = p["algorithmProperties"], p["certificateProperties"], p["relatedCryptoMaterialProperties"]
    al2 = F.when(al.isNotNull(), al.withField("ellipticCurve", F.coalesce(al["ellipticCurve"], al["curve"])).withField("curve", text))
    ce2 = F.when(ce.isNotNull(), ce.withField("certificateFileExtension", F.coalesce(ce["certificateFileExtension"], ce["certificateExtension"]))
                 .withField("relatedCryptographicAssets", _with_assets(ce, ("algorithm", ce["signatureAlgorithmRef"]), ("publicKey", ce["subjectPublicKeyRef"])))
                 .withField("certificateExtension", text).withField("signatureAlgorithmRef", text).withField("subjectPublicKeyRef", text))
    ma2 = F.when(ma.isNotNull(), ma.withField("relatedCryptographicAssets", _with_assets(ma, ("algorithm", ma["algorithmRef"]))).withField("algorithmRef", text))
    new = p.withField("algorithmProperties", al2).withField("certificateProperties", ce2).withField("relatedCryptoMaterialProperties", ma2)
    return assets.withColumn(column, new)


def prefer_detailed_transforms(transforms: DataFrame) -> DataFrame:
    """IKEv2 rows: where an asset has a detailed row of a kind (with a name),
    its plain reference rows of that kind are dropped."""
    detailed = F.max(F.col("name").isNotNull()).alias("_any")
    kinds = transforms.groupBy("bom_id", "ref", "transform").agg(detailed)
    return transforms.join(kinds, ["bom_id", "ref", "transform"]).filter("NOT _any OR name IS NOT NULL").drop("_any")


def upgrade_extensions(graph_edges: DataFrame, legacy: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables read from extension namespaces under the names of the core tables."""
    return {
        "dependency_edge": graph_edges, "vulnerability": legacy["vulnerability"].drop("ref"), "vuln_rating": legacy["rating"].drop("ref", "impact", "exploitability"),
        "vuln_cwe": legacy["cwe"].drop("ref"), "vuln_advisory": legacy["advisory"].drop("ref"), "vuln_affects": legacy["affects"],
    }
