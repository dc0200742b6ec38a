"""Rules over values as data: one relation of (kind of object, member, rule),
joined to the objects of all documents (:mod:`bomspark.operators.shred`) in one
scan. Every kind of object is covered; which members a kind may have comes from
the document shapes, so a new member needs no rule.

Emits ``violation`` rows as :mod:`bomspark.operators.rules` does. Times are
checked where they are text; null members are absent and break nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..model import enums as en
from . import shred
from .rules import ERROR, RowRule, WARNING, check_rows, union, version_number

# Members with a closed list of values, by kind.
ENUM_MEMBERS = {
    "license": {"acknowledgement": "acknowledgement"}, "licenseChoice": {"acknowledgement": "acknowledgement"},
    "licensing": {"licenseTypes": "license_type"}, "composition": {"aggregate": "aggregate"},
    "analysis": {"response": "response"}, "versions": {"status": "affected_status"},
    "cryptoProperties": {"assetType": "crypto_asset"},
    "algorithmProperties": {
        "primitive": "crypto_primitive", "mode": "crypto_mode", "padding": "crypto_padding", "cryptoFunctions": "crypto_function",
        "executionEnvironment": "crypto_environment", "implementationPlatform": "crypto_platform",
    },
    "relatedCryptoMaterialProperties": {"type": "crypto_material", "state": "material_state"}, "certificateState": {"state": "cert_state"},
    "protocolProperties": {"type": "crypto_protocol"}, "workflow": {"taskTypes": "task_type"}, "task": {"taskTypes": "task_type"},
    "trigger": {"type": "trigger_type"}, "output": {"type": "output_type"}, "workspace": {"accessMode": "access_mode"},
    "volume": {"mode": "volume_mode"}, "approach": {"type": "learning_approach"}, "energyConsumption": {"activity": "energy_activity"},
    "energyProvider": {"energySource": "energy_source"}, "patent": {"patentLegalStatus": "patent_status"},
    "patentAssertion": {"assertionType": "patent_assertion"},
}
# Members that hold a date and time, by kind.
TIME_MEMBERS = {
    "annotation": "timestamp", "vulnerability": "created published updated rejected", "analysis": "firstIssued lastUpdated",
    "author": "timestamp", "committer": "timestamp", "releaseNotes": "timestamp", "licensing": "lastRenewal expiration",
    "workflow": "timeStart timeEnd", "task": "timeStart timeEnd", "trigger": "timeActivated", "event": "timeReceived",
    "evidence": "created expires", "citation": "timestamp",
    "certificateProperties": "notValidBefore notValidAfter creationDate activationDate deactivationDate revocationDate destructionDate",
    "relatedCryptoMaterialProperties": "creationDate activationDate updateDate expirationDate",
}
# Members that hold a date alone, by kind.
DATE_MEMBERS = {"patent": "filingDate grantDate patentExpirationDate", "priorityApplication": "filingDate"}
# Pairs of times of one object, the earlier first.
ORDERED = {
    "licensing": [("lastRenewal", "expiration")], "evidence": [("created", "expires")], "workflow": [("timeStart", "timeEnd")],
    "task": [("timeStart", "timeEnd")], "analysis": [("firstIssued", "lastUpdated")],
    "vulnerability": [("created", "published"), ("created", "updated"), ("published", "updated")],
    "relatedCryptoMaterialProperties": [("creationDate", "activationDate"), ("creationDate", "expirationDate")],
    "certificateProperties": [("creationDate", "destructionDate")],
    "patent": [("filingDate", "grantDate"), ("filingDate", "patentExpirationDate")],
}


def wanted() -> dict[str, tuple[str, ...]]:
    """Members the rules read; every kind for its member names."""
    split = lambda d: {k: tuple(v.split()) for k, v in d.items()}
    pairs = {k: tuple(m for pair in v for m in pair) for k, v in ORDERED.items()}
    names = {kind: () for kind in shred.automaton()}
    return shred.merged(names, {k: tuple(v) for k, v in ENUM_MEMBERS.items()}, split(TIME_MEMBERS), split(DATE_MEMBERS), pairs)


def value_rules(spark: SparkSession) -> DataFrame:
    """The relation ``(element, member, rule, allowed, since)``: some eighty
    rows, whatever the corpus."""
    rows = []
    for kind, members in ENUM_MEMBERS.items():
        for member, name in members.items():
            rows.append((kind, member, "enum", list(en.ENUMS[name][1]) if name in en.ENUMS else list(en.VALUES[name]), en.VALUE_SINCE.get(name, {})))
    for rule, table in (("date_time", TIME_MEMBERS), ("date", DATE_MEMBERS)):
        rows += [(kind, member, rule, None, None) for kind, members in table.items() for member in members.split()]
    return spark.createDataFrame(rows, "element string, member string, rule string, allowed array<string>, since map<string, string>")


def member_rules(spark: SparkSession) -> DataFrame:
    """The relation ``(element, known, early)``: members of a kind, and the
    version in which the newer ones of them appear."""
    rows = [(kind, shred.known_members(kind), en.MEMBER_SINCE.get(kind, {})) for kind in shred.automaton()]
    return spark.createDataFrame(rows, "element string, known array<string>, early map<string, string>")


def _older(version: Column, since: Column) -> Column:
    return version_number(version) < version_number(since)


def check_values(objs: DataFrame) -> DataFrame:
    """Values outside their list, too new for their document, or no time."""
    # a fixed relation of constants: its size doesn't depend on any input
    rows = shred.values_of(objs).join(F.broadcast(value_rules(objs.sparkSession)), ["element", "member"])
    v, since = F.col("value"), F.try_element_at("since", F.col("value"))
    bad = (
        F.when(F.col("rule") == "enum", ~F.array_contains("allowed", v) | F.coalesce(_older(F.col("spec_version"), since), F.lit(False)))
        .when(F.col("rule") == "date_time", ~(v.rlike(en.anchored("date_time")) & F.try_to_timestamp(v).isNotNull()))
        .otherwise(~(v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.expr("try_cast(value AS date)").isNotNull()))
    )
    name = F.when(F.col("rule") == "enum", "enum").otherwise("timestamp")
    return rows.filter(bad).select("bom_id", name.alias("rule"), F.lit(ERROR).alias("severity"), "pointer", F.concat_ws("=", "member", v).alias("value"))


def check_order(objs: DataFrame) -> DataFrame:
    """Times of one object that run backwards."""
    at = lambda m: F.try_to_timestamp(F.col("fields")[m])
    rules = [
        RowRule("date_order", (F.col("element") == kind) & (at(a) > at(b)), F.lit(f"{a} > {b}"), WARNING)
        for kind, pairs in ORDERED.items() for a, b in pairs
    ]
    return check_rows(objs.filter(F.col("element").isin(*ORDERED)), rules)


def check_members(objs: DataFrame) -> DataFrame:
    """Members that a kind of object does not have, or not in the version of its document."""
    rows = objs.join(F.broadcast(member_rules(objs.sparkSession)), "element")
    strange = F.array_except("names", "known")
    early = F.filter("names", lambda n: F.coalesce(_older(F.col("spec_version"), F.try_element_at(F.col("early"), n)), F.lit(False)))
    return rows.select("bom_id", "pointer", "element", F.explode(F.array_union(strange, early)).alias("member")).select(
        "bom_id", F.lit("unknown_field").alias("rule"), F.lit(ERROR).alias("severity"), "pointer", F.concat_ws(".", "element", "member").alias("value")
    )


def check_objects(objs: DataFrame) -> DataFrame:
    """All rules of this module over objects shredded with :func:`wanted`."""
    return union([check_values(objs), check_order(objs), check_members(objs)])
