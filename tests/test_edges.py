"""Cases at the edge: long numbers, open ends, null keys, binary texts, deep graphs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bomspark.functions import scalars as S
from bomspark.operators import aggs as A, flatten as X, graph as G, joins as J, migrate as M, rules as R, sets, text as T, windows as W
from bomspark.sources import documents as IO


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v"))).collect()]


def test_versions_of_any_length_sort(spark):
    order = ["1.0-rc2", "1.0-rc10", "1.0-rc123456789012345678901", "1", "1.0.1", "2", "99999999999999999999", "100000000000000000000", "100000000000000000000.1"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(order)], "i int, v string")
    assert [r.i for r in rows.orderBy(S.version_key("v")).collect()] == list(range(len(order)))
    assert one(spark, lambda c: S.version_key(c).isNull(), "abc", "007") == [True, False]


def test_package_urls_with_scope_and_at_signs(spark):
    got = one(spark, S.purl_without_version, "pkg:npm/@ng/core@1.0", "pkg:npm/a/b?vcs_url=git@host", "pkg:gem/x@1#sub/@y", "pkg:npm/@ng/core")
    assert got == ["pkg:npm/@ng/core", "pkg:npm/a/b", "pkg:gem/x", "pkg:npm/@ng/core"]


def test_long_platform_name(spark):
    got = one(spark, lambda c: S.cpe_parts(c)["product"], "cpe:2.3:a:v:" + "p" * 200_000 + ":1")
    assert len(got[0]) == 200_000


def test_means_keep_small_and_large_values(spark):
    df = spark.createDataFrame([(1, 0.00000049), (2, 1e15), (3, 0.1), (3, 0.2), (4, 1e300), (5, None)], "k int, v double")
    got = {r.k: r.m for r in df.groupBy("k").agg(A.exact_mean("v").alias("m")).collect()}
    assert got[1] == 0.00000049 and got[2] == 1e15 and got[4] == 1e300 and got[5] is None
    assert abs(got[3] - 0.15) < 1e-15


def test_concentration_of_very_many_components(spark):
    df = spark.createDataFrame([("t", 1)], "type string, supplier_id int")
    big = F.sum(F.col("n").cast("double") * F.col("n")) / (F.sum("n").cast("double") * F.sum("n"))
    assert spark.createDataFrame([(4 * 10**9,)], "n long").agg(big).first()[0] == 1.0
    assert A.supplier_concentration(df).first().herfindahl == 1.0


def test_open_intervals(spark):
    day = lambda y, m, d: dt.datetime(y, m, d)
    iv = spark.createDataFrame(
        [("k", 1, day(2020, 1, 5), None), ("k", 2, None, day(2021, 1, 1)), ("k", 3, day(1950, 1, 1), day(2150, 1, 1)), ("k", 4, day(2020, 2, 1), day(2020, 2, 10)), ("k", 5, day(2019, 1, 1), day(2022, 1, 1)), ("k", 6, day(2021, 1, 1), day(2020, 1, 1))],
        "k string, i int, a timestamp_ntz, b timestamp_ntz")
    pt = spark.createDataFrame([("k", day(2020, 2, 3)), ("k", day(2030, 1, 1)), ("k", day(1949, 1, 1))], "k string, at timestamp_ntz")
    got = {(r.at.year, r.i) for r in J.interval_join(pt, iv, "k", "a", "b").collect()}
    assert got == {(2020, 1), (2020, 2), (2020, 3), (2020, 4), (2020, 5), (2030, 1), (2030, 3), (1949, 2)}
    assert {r.i for r in J.valid_at(iv, "a", "b", F.lit(day(2030, 1, 1))).collect()} == {1, 3}


def test_alias_groups_keep_records_without_source(spark):
    v = spark.createDataFrame([(1, "A", "s"), (2, "A", "s"), (3, "A", None), (4, "A", None), (5, "B", None)], "vuln_key long, id string, source_name string")
    got = {r.vuln_key: r.group_key for r in sets.alias_groups(v, [F.col("id"), F.col("source_name")]).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_binary_and_broken_attachments(spark):
    rows = [(1, "base64", "/9j/4AAQ"), (2, "base64", "*"), (3, None, "plain"), (4, "base64", "aGk="), (5, "base64", None)]
    got = {r.i: (r.text, r.n_bytes, r.valid) for r in T.decode_attachments(spark.createDataFrame(rows, "i int, encoding string, content string")).collect()}
    assert got == {1: (None, 6, True), 2: (None, None, False), 3: ("plain", 5, True), 4: ("hi", 2, True), 5: (None, None, True)}


def test_spec_versions_are_numbers(spark):
    got = one(spark, lambda c: R.version_number(c) < R.version_number(F.lit("1.5")), "1.10", "1.4", "1.5")
    assert got == [False, True, False]


def test_merged_entries_lose_nothing(spark):
    df = spark.createDataFrame([([(None, ["a"]), ("n", ["b", "c"])], ["x", "y"]), ([], None)], "e array<struct<name string, list array<string>>>, t array<string>")
    first, second = M.upgrade_cardinality(df, to_one=("e", "t")).collect()
    assert first.e.name == "n" and first.e.list == ["a", "b", "c"] and (first.t, first.t_more) == ("x", ["y"])
    assert second.e is None and second.t is None


def test_levels_without_a_cap_and_cycles(spark):
    chain = spark.range(30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    both = chain.union(spark.createDataFrame([(0, 30)], "src long, dst long"))
    assert {r.node: r.level for r in G.longest_levels(both).collect()} == {i: i for i in range(31)}
    with pytest.raises(ValueError):
        G.longest_levels(chain.union(spark.createDataFrame([(9, 5)], "src long, dst long")))


def test_pointer_table_goes_to_the_bottom(spark):
    depth = 40
    docs = spark.createDataFrame([("d", '{"a":' * depth + "1" + "}" * depth)], "bom_id string, content string")
    assert X.pointer_table(docs).count() == depth + 1


def test_positions_follow_the_sort(spark):
    df = spark.range(500).select(
        (F.col("id") % 3).cast("string").alias("type"), F.lit("g").alias("comp_group"), F.lit("n").alias("name"), F.concat((F.col("id") % 50).cast("string"), F.lit(".1")).alias("version"),
        F.col("id").alias("bom_id"), F.lit("r").alias("bom_ref"), F.lit(1).alias("supplier_id"))
    got = W.sort_inventory(df.repartition(7), S.version_key("version")).collect()
    want = sorted(got, key=lambda r: (r.type, int(r.version.split(".")[0]), r.bom_id))
    assert [r.position for r in want] == list(range(1, 501))


def test_one_document_is_one_row(spark):
    boms = spark.createDataFrame([(1, "urn:uuid:s", 1, "1.7", "build", "RED")], "bom_id long, serial_number string, version int, spec_version string, lifecycle_phase string, tlp string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    comps = spark.range(20_000).select(F.lit(1).cast("long").alias("bom_id"), F.col("id").cast("string").alias("bom_ref"), F.lit("file").alias("type"), F.lit("n").alias("name"))
    assert IO.bom_documents(boms, comps).count() == 1


def test_reference_groups_follow_chains(spark):
    v = spark.createDataFrame([(1, "A"), (2, "b"), (3, "C"), (4, None), (5, "E"), (6, "A "), (None, "A"), (7, "H"), (1, "A")], "vuln_key long, id string")
    r = spark.createDataFrame([(1, "B"), (2, "c"), (5, "GHSA-x"), (4, "ghsa-X"), (9, "A"), (7, ""), (7, None)], "vuln_key long, id string")
    got = {x.vuln_key: x.group_key for x in sets.reference_groups(v, r).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 1, 4: 4, 5: 4, 7: 7}
    assert sets.reference_groups(v.limit(0), r).count() == 0


def test_reference_groups_of_a_shared_id_stay_linear(spark):
    v = spark.range(20_000).selectExpr("id AS vuln_key", "concat('V-', id) AS id")
    r = v.selectExpr("vuln_key", "'shared' AS id")
    assert sets.reference_edges(v, r).count() == 39_999
    assert sets.reference_groups(v, r).filter("group_key = 0").count() == 20_000
