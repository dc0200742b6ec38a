"""Streaming jobs. Each transformation takes a frame and works on a stream and
on a batch alike; the runners write what a stream emits to a shared folder.

State is bounded by the watermark, or by the number of keys where the result
itself is one row per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.skew import newest_per_key
from ..session import scratch_path


def file_stream(spark: SparkSession, path: str, schema, max_files: int | None = None, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


# ------------------------------------------------------------------ runners

def run_append(stream: DataFrame, label: str) -> DataFrame:
    """Process what is there, append rows to Parquet, return them as a table.
    The file sink commits a batch once, also after a restart."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    q = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", scratch_path(spark, label + "-state")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_upsert(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Update mode: each batch writes its changed rows to its own folder (a
    retry overwrites it); the table is the newest row per key."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    q = (
        stream.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", scratch_path(spark, label + "-state")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    rows = spark.read.parquet(out).drop("part")
    return newest_per_key(rows, keys, [F.col("_batch")]).drop("_batch")


# ------------------------------------------------------------------ transformations

def severity_tumbling(vulns: DataFrame, length: str = "1 hour", delay: str = "1 day") -> DataFrame:
    w = vulns.withWatermark("published_at", delay).groupBy(F.window("published_at", length), "severity")
    return w.agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "severity", "n")


def severity_sliding(vulns: DataFrame, length: str = "24 hours", slide: str = "6 hours", delay: str = "1 day") -> DataFrame:
    w = vulns.withWatermark("published_at", delay).groupBy(F.window("published_at", length, slide), "severity")
    return w.agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "severity", "n")


def scan_sessions(vulns: DataFrame, gap: str = "12 hours", delay: str = "1 day") -> DataFrame:
    w = vulns.withWatermark("published_at", delay).groupBy(F.session_window("published_at", gap), "package_id")
    return w.agg(F.count("*").alias("n")).select(
        "package_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n"
    )


def dedupe(vulns: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """First record per key inside the watermark delay."""
    d = vulns.withWatermark("published_at", delay)
    return d.dropDuplicatesWithinWatermark(keys) if vulns.isStreaming else d.dropDuplicates(keys)


def match_inventory(vulns: DataFrame, inventory: DataFrame) -> DataFrame:
    """Stream against a static table of packages in use."""
    return vulns.join(inventory, "package_id")


def releases_near_vulnerabilities(releases: DataFrame, vulns: DataFrame, days: int = 7, delay: str = "1 day") -> DataFrame:
    """Releases of a package at most ``days`` before a vulnerability of it."""
    r = releases.withWatermark("released_at", delay).select(F.col("package_id").alias("_p"), "released_at", "n_documents")
    v = vulns.withWatermark("published_at", delay)
    near = (F.col("package_id") == F.col("_p")) & (F.col("released_at") <= F.col("published_at")) & (
        F.col("released_at") >= F.col("published_at") - F.expr(f"INTERVAL {days} DAYS")
    )
    return v.join(r, near).drop("_p")


def latest_documents(boms: DataFrame) -> DataFrame:
    """Newest version per serial number; one row of state per serial."""
    rest = [c for c in boms.columns if c != "serial_number"]
    best = boms.groupBy("serial_number").agg(F.max_by(F.struct(*rest), F.struct("version", "bom_id")).alias("_b"))
    return best.select("serial_number", *[F.col("_b")[c].alias(c) for c in rest])


def analysis_state(analyses: DataFrame) -> DataFrame:
    """Current state per (package, source), since when it was first seen in
    triage and for how long: to the newest record while it is in triage, to the
    last one in triage after that."""
    in_triage = F.when(F.col("analysis_state") == "in_triage", F.col("published_at"))
    triage = F.min(in_triage)
    got = analyses.groupBy("package_id", "source_name").agg(
        F.max_by("analysis_state", F.struct("published_at", "vuln_key")).alias("state"), triage.alias("triage_since"),
        F.max("published_at").alias("updated_at"), F.max(in_triage).alias("_last"),
    )
    until = F.when(F.col("state") == "in_triage", F.col("updated_at")).otherwise(F.col("_last"))
    return got.withColumn("seconds_in_triage", F.unix_seconds(until) - F.unix_seconds("triage_since")).drop("_last")


def split_late(stream: DataFrame, event_time: str, delay: str, label: str, deliveries: tuple[Callable[[], None], ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(on time, late): a row is late when its event time lies more than
    ``delay`` behind the newest one of earlier batches. Each batch leaves its
    newest event time as one row, so a restart finds the same boundary. The
    stream runs over what is there, then once more after each of ``deliveries``."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)

    def route(batch: DataFrame, batch_id: int) -> None:
        seen = [spark.read.parquet(f"{out}/seen/part={i}").first()["t"] for i in range(max(0, batch_id - 1), batch_id)]
        newest = max([t for t in seen if t is not None], default=None)
        limit = F.lit(newest) - F.expr(f"INTERVAL {delay}") if newest is not None else F.lit(None).cast("timestamp")
        marked = batch.withColumn("_late", F.coalesce(F.col(event_time) < limit, F.lit(False)))
        marked.write.mode("overwrite").parquet(f"{out}/rows/part={batch_id}")
        here = batch.agg(F.greatest(F.max(event_time), F.lit(newest).cast("timestamp")).alias("t"))
        here.coalesce(1).write.mode("overwrite").parquet(f"{out}/seen/part={batch_id}")

    state = scratch_path(spark, label + "-state")
    for deliver in (None, *deliveries):
        if deliver:
            deliver()
        stream.writeStream.foreachBatch(route).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").drop("part")
    return rows.filter("NOT _late").drop("_late"), rows.filter("_late").drop("_late")


class ExpiryAlerts(StatefulProcessor):
    """One timer per certificate, a lead time before its end; emits when the
    watermark passes it."""

    def __init__(self, lead_ms: int):
        self.lead_ms = lead_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.end = handle.getValueState("end", "end_ms long, alerted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end = max(int(pdf["end_ms"].max()) for pdf in rows)
        known = self.end.get()  # each call is a trip to the state server
        if known is not None:
            if end <= int(known[0]):
                return  # the timer stands, or the alert has been given
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.end.update((end, False))
        self.handle.registerTimer(end - self.lead_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a key has one timer, set by its end; the end stays, so nobody is alerted twice
        end = int(expiredTimerInfo.getExpiryTimeInMs()) + self.lead_ms
        yield pd.DataFrame({"cert_id": [int(key[0])], "end_ms": [end]})

    def close(self) -> None:
        pass


#: Keys of the alerts' state. A group's certificates are one packed value, so a batch takes calls a group, not a certificate.
ALERT_GROUPS = 1024


class GroupedExpiryAlerts(StatefulProcessor):
    """What :class:`ExpiryAlerts` does, for all certificates whose ids hash to
    a group: 17 bytes of state a certificate, and one timer a group at the first
    alert that is still to be given. Rows without an end tell nothing."""

    def __init__(self, lead_ms: int):
        self.lead_ms = lead_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("ends", "ids binary, ends binary, alerted binary, timer long")

    def _known(self) -> tuple[pd.DataFrame, int | None]:
        held = self.held.get()
        if held is None:
            held = (b"", b"", b"", None)
        ids, ends, alerted = (np.frombuffer(bytes(b), kind) for b, kind in zip(held, ("<i8", "<i8", "?")))
        return pd.DataFrame({"cert_id": ids, "end_ms": ends, "alerted": alerted}), held[3]

    def _keep(self, known: pd.DataFrame, timer: int | None, fired: bool = False) -> None:
        """Sets the timer to the first alert still to be given."""
        open_ = known["end_ms"][~known["alerted"]]
        first = int(open_.min()) - self.lead_ms if len(open_) else None
        if fired or first != timer:
            if timer is not None and not fired:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        packed = [known[c].to_numpy(kind).tobytes() for c, kind in (("cert_id", "<i8"), ("end_ms", "<i8"), ("alerted", "?"))]
        self.held.update((*packed, first))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told = [pdf[["cert_id", "end_ms"]].dropna().astype("int64").groupby("cert_id", as_index=False).max() for pdf in rows]
        new = pd.concat(told).assign(alerted=False)
        if len(new):
            known, timer = self._known()
            # the latest end of a certificate counts; an equal one keeps the alert that has been given
            every = pd.concat([known, new]).sort_values(["cert_id", "end_ms", "alerted"], kind="stable")
            self._keep(every.drop_duplicates("cert_id", keep="last"), timer)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, timer = self._known()
        due = ~known["alerted"] & (known["end_ms"] - self.lead_ms <= timerValues.getCurrentWatermarkInMs())
        self._keep(known.assign(alerted=known["alerted"] | due), timer, fired=True)
        yield known.loc[due, ["cert_id", "end_ms"]]

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def expiry_alerts(certificates: DataFrame, lead_days: int = 30, delay: str = "1 day", groups: int = ALERT_GROUPS) -> DataFrame:
    """``certificates(cert_id, at, not_valid_after)`` -> certificates whose end
    is at most ``lead_days`` ahead of the watermark. A restart has to keep ``groups``."""
    certificates.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    end_ms = F.unix_millis("not_valid_after").alias("end_ms")
    group = F.pmod(F.xxhash64("cert_id"), F.lit(groups)).alias("group")
    keyed = certificates.withWatermark("at", delay).select(group, "cert_id", "at", end_ms).groupBy("group")
    return keyed.transformWithStateInPandas(
        GroupedExpiryAlerts(lead_days * 86_400_000), "cert_id long, end_ms long", "append", "eventtime"
    ).select("cert_id", F.timestamp_millis("end_ms").alias("not_valid_after"))


def expiring(certificates: DataFrame, watermark, lead_days: int = 30) -> DataFrame:
    """Batch twin of :func:`expiry_alerts` at a given watermark."""
    return certificates.filter(F.col("not_valid_after") - F.make_dt_interval(days=F.lit(lead_days)) <= watermark).select("cert_id", "not_valid_after")
