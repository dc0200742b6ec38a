"""Alerts keep their state by groups of certificates: calls a group, not a certificate."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from bomspark.session import scratch_path
from bomspark.streaming import jobs as J


class Fake:
    """State, handle, timer and watermark of one group."""

    def __init__(self):
        self.held, self.timers, self.calls, self.mark = None, [], 0, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.held

    def update(self, v):
        self.calls += 1
        self.held = v

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_calls_do_not_grow_with_certificates():
    f, p = Fake(), J.GroupedExpiryAlerts(10)
    p.init(f)

    def rows(*pairs):
        list(p.handleInputRows((0,), iter([pd.DataFrame(pairs, columns=["cert_id", "end_ms"])]), f))

    def pass_(mark):
        f.mark, out = mark, []
        while f.timers and f.timers[0] <= mark:
            (got,) = p.handleExpiredTimer((0,), f, None)
            f.timers.pop(0)
            out += list(got.itertuples(index=False, name=None))
        return out

    rows(*[(i, 100 + i) for i in range(1000)], (7, 50), (None, 5), (8, None))
    assert f.calls == 3 and f.timers == [90]
    rows((0, 5000), (1, 90))  # a later end moves the alert, an earlier one doesn't
    assert f.timers == [91]
    assert pass_(92) == [(1, 101), (2, 102)]
    rows((1, 101), (2, 300), (3, 103))
    assert f.timers == [93]
    assert sorted(pass_(290)) == [(2, 300), *[(i, 100 + i) for i in range(3, 201)]]
    assert len(pass_(10**6)) == 1000 - 201 + 1 and pass_(10**6) == [] and f.timers == []


def test_alerts_of_a_stream_with_renewed_and_endless_certificates(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    first = [(1, day(0), day(40)), (2, day(1), day(400)), (3, day(2), day(20)), (3, day(2), day(20)), (4, day(3), None), (5, day(3), day(41))]
    later = [(5, day(5), day(300)), (6, day(50), day(90))]
    out = scratch_path(spark, "alerts-in")
    schema = "cert_id long, at timestamp, not_valid_after timestamp"
    for n, part in enumerate((first, later)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{out}/{n}")
    stream = J.file_stream(spark, f"{out}/*", spark.read.parquet(f"{out}/0").schema)
    got = J.run_append(J.expiry_alerts(stream, groups=2), "alerts")
    assert sorted((r.cert_id, r.not_valid_after) for r in got.collect()) == [(1, day(40)), (3, day(20))]
    want = J.expiring(spark.read.parquet(f"{out}/*").filter("cert_id <> 5"), F.lit(day(49)).cast("timestamp")).distinct()
    assert sorted(map(tuple, want.collect())) == [(1, day(40)), (3, day(20))]
