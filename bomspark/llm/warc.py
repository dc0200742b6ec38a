"""WARC archives without repeated payloads.

Headers (page, payload digest, length) are shuffled by digest; the record of
the largest page_id of equal payloads is the response, the others become
revisits that refer to it. Archives are written by Spark as text with the
record separator between records, so they can lie in any store Spark reaches,
and are read back by Content-Length.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bomspark.session import cut, scratch_path

#: Shorter payloads are always written in full.
MIN_PAYLOAD = 1000
#: Headers of one digest are dealt to so many tasks.
SALTS = 16
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SEPARATOR = "\r\n\r\n"


def resolve(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``pages`` with payload, payload_bytes, payload_digest and refers_to
    (null in responses). Only headers are grouped; the digests that repeat are
    joined back to them in salted copies, so a digest of many pages is spread."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"))
    long = rows.where(F.col("payload_bytes") >= min_payload).where("page_id is not null")
    chosen = long.groupBy("payload_digest").agg(F.max("page_id").alias("head"), F.min("page_id").alias("low")).where("low < head").select("payload_digest", "head")
    chosen = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    out = salted.join(chosen, ["payload_digest", "salt"], "left")
    revisit = (F.col("payload_bytes") >= min_payload) & (F.col("page_id") < F.col("head"))
    return out.withColumn("refers_to", F.when(revisit, F.col("head"))).drop("salt", "head")


def _record_id(page_id: Column, digest: Column, kind: str) -> Column:
    """The same urn whenever a task is run again."""
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("")), digest, F.lit(kind)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def records(resolved: DataFrame) -> DataFrame:
    """One column ``value``: a whole record up to its closing separator."""
    is_revisit = F.col("refers_to").isNotNull()
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_SEPARATOR))
    block = F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), F.when(is_revisit, _record_id(F.col("page_id"), F.col("payload_digest"), "revisit")).otherwise(_record_id(F.col("page_id"), F.col("payload_digest"), "response"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Page-ID: "), F.col("page_id").cast("string")),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to"), F.col("payload_digest"), "response"))),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))),
        F.when(is_revisit, F.lit(f"WARC-Refers-To-Date: {DATE}")),
        F.when(is_revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return resolved.select(F.concat(head, F.lit(_SEPARATOR), block).alias("value"))


def write(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD, records_per_file: int = 20_000) -> None:
    """Gzipped archives below ``path``. Each ends in the separator of its last record."""
    out = records(resolve(pages, min_payload)).write.option("lineSep", _SEPARATOR).option("compression", "gzip")
    out.option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes):
    """(headers, block) of each record of an archive; a cut or broken record ends it with an error."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        start = end + 4
        at = start + int(head["content-length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {start} isn't {head['content-length']} bytes long")
        yield head, data[start:at]
        at += 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_id, record_type, payload_bytes (as the HTTP header
    states it), payload_digest, refers_to, refers_to_id, payload (null in
    revisits) of every record below ``path``. One archive is one row of bytes
    at first; ``records_per_file`` bounds it."""

    def run(batches):
        kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("refers_to_id", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for head, block in parse(zlib.decompress(content.as_py(), 31)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.rsplit(b": ", 1)[1])
                    revisit = head["warc-type"] == "revisit"
                    number = lambda k, head=head: int(head[k]) if k in head else None
                    rows.append((number("warc-page-id"), head["warc-target-uri"], head["warc-record-id"], head["warc-type"], length, head["warc-payload-digest"].removeprefix("sha1:"), number("warc-refers-to-page-id"), head.get("warc-refers-to"), None if revisit else payload))
                    if len(rows) == 2_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, refers_to_id string, payload binary")


def read_resolved(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes and payload_digest of the full
    payload, record_type, refers_to, and intact: the payload that is there, or
    the one of the response a revisit refers to, has that length and digest.

    Revisits meet their responses by record id, in salted copies of the
    responses' headers; payloads stay where they were read."""
    rows = read(spark, path)
    ok = (F.octet_length("payload") == F.col("payload_bytes")) & (F.sha1("payload") == F.col("payload_digest"))
    # headers only; one reading of the archives serves both sides of the join
    rows = cut(rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_to_id", "record_id", ok.alias("whole")))
    heads = rows.where("record_type = 'response'")
    heads = heads.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.first("payload_digest").alias("d"), F.first("payload_bytes").alias("n"), F.min("whole").alias("w"))
    wanted = rows.where("refers_to_id is not null").select("refers_to_id").distinct()
    heads = heads.join(wanted, "refers_to_id", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # responses refer to nothing; a key of their own spreads them
    salted = rows.withColumn("refers_to_id", F.coalesce("refers_to_id", F.concat(F.lit("-"), "record_id")))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    out = salted.join(heads, ["refers_to_id", "salt"], "left")
    found = (F.col("d") == F.col("payload_digest")) & (F.col("n") == F.col("payload_bytes")) & F.col("w")
    intact = F.when(F.col("record_type") == "response", F.col("whole")).otherwise(F.coalesce(found, F.lit(False)))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", intact.alias("intact"))


def round_trip(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back.

    A null html is an empty payload; short and empty payloads are responses;
    rows that repeat the response's page_id and payload are responses as well;
    a null page_id is a response that nothing refers to; control characters
    and spaces of a url become %20; other columns are ignored; an empty table
    gives no rows."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, min_payload)
    return read_resolved(pages.sparkSession, path)
