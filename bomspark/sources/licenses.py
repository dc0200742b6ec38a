"""The license list as a dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_ROW = "_value string, annotation struct<documentation string>"


def _entries(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return (
        spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(_ROW).load(path)
        .select(
            F.col("_value").alias("license_id"), F.col("annotation.documentation").alias("name"),
            F.monotonically_increasing_id().alias("_pos"),
        )
        .filter("license_id IS NOT NULL")
    )


def dedupe_by_id(entries: DataFrame) -> DataFrame:
    """An id that occurs again keeps its first position and takes the later name."""
    return entries.groupBy("license_id").agg(
        F.max_by("name", "_pos").alias("name"), F.min("_pos").alias("position")
    )


# Fixed value: the id that opens the second list (exceptions) of the file.
FIRST_EXCEPTION = "389-exception"


def read_license_list(
    spark: SparkSession, path: str, row_tag: str = "enumeration", first_exception: str = FIRST_EXCEPTION
) -> DataFrame:
    """``license_id, name, position, kind``: the licenses, then the exceptions,
    in the order of the file."""
    out = dedupe_by_id(_entries(spark, path, row_tag))
    start = out.filter(F.col("license_id") == first_exception).agg(F.min("position")).scalar()
    kind = F.when(F.col("position") >= start, "exception").otherwise("license")
    return out.withColumn("kind", kind).orderBy("position")
