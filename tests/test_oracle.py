"""Registered queries against DuckDB on the small tables. A sample by default;
BOMSPARK_ALL=1 runs every query."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from bomspark.plans import ORACLE, QUERIES
from check import TABLES, norm

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "flagship_open_risk latest_bom vulnerability_status match_vulnerabilities bom_as_of_each task_overlap bom_diff component_timeline "
    "rank_ratings severity_quartiles merge_boms dependency_cycles alias_groups flatten_components explode_dependencies assembly_tree "
    "rule_enum document_verdict write_bom_json read_bom_xml upgrade_crypto stream_scan_sessions license_distribution noisy_or"
).split()
NAMES = sorted(E.oracle_sql()) if os.environ.get("BOMSPARK_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLE)
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    assert E.entry(spark).count() > 0
