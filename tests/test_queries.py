import duckdb
import pytest

import __spark_entry__

FEW = {"c26_fingerprint_pairs"}  # no such pair among so few rows
CORE = [n for m in __spark_entry__.CORE for n in __import__(m, fromlist=["QUERIES"]).QUERIES]


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    return str(value) if value is not None and not isinstance(value, (int, bool, str)) else value


@pytest.mark.parametrize("name", CORE)
def test_query_against_sql(spark, small, name):
    rows = __spark_entry__.queries()[name](spark, small)
    columns = sorted(rows.columns)
    found = sorted(repr([plain(r[c]) for c in columns]) for r in rows.collect())
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert (found or name in FEW) and len(found) == len(set(found)), "rows, and none twice"
        return
    db = duckdb.connect()
    for table in ("posts comments items observations cluster_candidate_pairs documents snapshots sources person_names pack_targets events embeddings").split():
        db.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert found == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
