"""Every query with SQL gives what DuckDB gives."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from kinfold import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = con.execute(Q.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    want = sorted((tuple(row[columns.index(c)] for c in sorted(columns)) for row in result.fetchall()), key=repr)
    df = Q.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in sorted(columns)) for r in df.collect()), key=repr) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_kinds_of_keys(spark):
    kinds = {r.key.split(":")[0] for r in Q.QUERIES["block_keys"](spark, SF).collect()}
    assert kinds == {"email", "local", "phone7", "sound-company", "domain-name", "company-initial", "name"}


def test_queries_show_something(spark):
    SF = "/root/testdata/sf0.01"
    assert {r.rule for r in Q.QUERIES["rule_refusals"](spark, SF).collect()} == {"corporate mailboxes at two employers", "generations differ"}
    assert {r.route for r in Q.QUERIES["scored_edges"](spark, SF).select("route").distinct().collect()} == {"refused", "accepted", "review", "below"}
    assert Q.QUERIES["clean_review"](spark, SF).count() > 0
