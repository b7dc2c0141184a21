import duckdb
import pytest

from corvane.llm.queries import ORACLE, QUERIES

COLUMNS = {
    "p1_found": "experiment_id item_id group_id", "p3_found": "item_id_a item_id_b", "p4_found": "field_name record_id pii_kind seq", "p6_found": "snapshot_date item_id", "p7_found": "field_name record_id",
    "p8_ids": "doc_id ids", "p10_found": "doc_id_a doc_id_b",
}


@pytest.mark.parametrize("name", QUERIES)
def test_query_gives_distinct_rows_of_its_columns(spark, small, name):
    rows = QUERIES[name](spark, small)
    found = [repr(tuple(r)) for r in rows.collect()]
    assert found and (len(set(found)) == len(found) or name in ("p4_redacted",))
    if name in COLUMNS:
        assert rows.columns == COLUMNS[name].split()
    if name in ORACLE:
        db = duckdb.connect()
        for table in ("posts", "items"):
            db.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
        assert sorted(map(tuple, rows.collect())) == sorted(db.execute(ORACLE[name]).fetchall())


def test_packing_fills_its_containers(spark, small):
    rows = QUERIES["p9_packed"](spark, small).where("container_id is not null").groupBy("target_id", "container_id").sum("tokens").collect()
    capacity = {r["target_id"]: r["capacity_tokens"] for r in spark.read.parquet(f"{small}/pack_targets.parquet").collect()}
    for target, most in capacity.items():
        loads = [r["sum(tokens)"] for r in rows if r["target_id"] == target]
        # The lower bound is the sum over the capacity, rounded up; a few containers more are allowed.
        assert max(loads) <= most and len(loads) <= -(-sum(loads) // most) * 1.05 + 1
