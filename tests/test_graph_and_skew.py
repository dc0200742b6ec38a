import random

from pyspark.sql import Window, functions as F

from bomspark.operators import graph as G, migrate as M, skew, windows as W
from bomspark.streaming import jobs


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def brute_reach(edges, start):
    depth, frontier = {s: 0 for s in start}, set(start)
    while frontier:
        frontier = {d for s, d in edges if s in frontier and d not in depth}
        d0 = max(depth.values()) + 1
        depth.update({f: d0 for f in frontier})
    return depth


def test_reach_and_cycles_against_brute_force(spark):
    rnd = random.Random(7)
    edges = list({(rnd.randrange(30), rnd.randrange(30)) for _ in range(45)})
    e = frame(spark, edges)
    start = spark.createDataFrame([(0,), (5,)], "node long")
    got = {r.node: r.depth for r in G.transitive_dependencies(e, start).collect()}
    assert got == brute_reach(edges, [0, 5])
    assert {r.node: r.depth for r in G.transitive_dependencies(e, start, max_depth=1).collect()} == {n: d for n, d in got.items() if d <= 1}
    nodes = {n for x in edges for n in x}
    on_cycle = {n for n in nodes if any(n in brute_reach(edges, [d]) for s, d in edges if s == n)}
    assert {r.node for r in G.dependency_cycles(e).collect()} == on_cycle


def test_components_levels_paths(spark):
    e = frame(spark, [(1, 2), (2, 3), (1, 3), (10, 11)])
    assert {(r.node, r.component) for r in G.connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (10, 10), (11, 10)}
    assert {(r.node, r.level) for r in G.longest_levels(e).collect()} == {(1, 0), (2, 1), (3, 2), (10, 0), (11, 1)}
    p = {r.node: r.path for r in G.shortest_paths(e, spark.createDataFrame([(1,)], "node long")).collect()}
    assert p == {1: "1", 2: "1>2", 3: "1>3"}


def test_split_windows_equal_plain_windows_on_a_hot_key(spark):
    df = spark.range(600).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20).alias("k"), "id", (F.col("id") * 7 % 11).alias("v"))
    w = Window.partitionBy("k").orderBy("id")
    want = df.withColumn("prev", F.lag("v").over(w)).withColumn("run", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bucket = F.floor(F.col("id") / 50)
    got = skew.split_running_sum(skew.split_lag(df, ["k"], ["id"], bucket, {"prev": "v"}), ["k"], ["id"], bucket, F.col("v"), "run")
    cols = ["k", "id", "v", "prev", "run"]
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(map(tuple, want.select(cols).collect()), key=str)


def test_missing_serial_stands_alone(spark):
    b = spark.createDataFrame([(1, "s", 1), (2, "s", 2), (3, None, 1), (4, None, 1)], "bom_id long, serial_number string, version int")
    assert {r.bom_id for r in W.latest_bom(b).collect()} == {2, 3, 4}


def test_detailed_transforms_win(spark):
    t = spark.createDataFrame([("b", "r", "encr", None, "x"), ("b", "r", "encr", "AES", "y"), ("b", "r", "prf", None, "z")],
                              "bom_id string, ref string, transform string, name string, algorithm string")
    assert {r.algorithm for r in M.prefer_detailed_transforms(t).collect()} == {"y", "z"}


def test_stream_in_several_batches_equals_batch(spark, folder):
    v = spark.range(300).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 900).alias("published_at"), F.when(F.col("id") % 2 == 0, "low").otherwise("high").alias("severity"))
    for i in range(3):
        part = v.filter((F.unix_seconds("published_at") - 1_700_000_000) / 90000 - i >= 0).filter((F.unix_seconds("published_at") - 1_700_000_000) / 90000 - i < 1)
        part.coalesce(1).write.parquet(f"{folder}/{i}")
    far = v.limit(1).withColumn("published_at", F.lit("2030-01-01").cast("timestamp"))
    far.coalesce(1).write.parquet(f"{folder}/9")
    stream = jobs.file_stream(spark, folder + "/*", v.schema, max_files=1)
    got = jobs.run_append(jobs.severity_tumbling(stream), "t").collect()
    want = v.groupBy(F.window("published_at", "1 hour"), "severity").count().select("window.start", "severity", "count").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
