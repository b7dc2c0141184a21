from pyspark.sql import functions as F

from corvane.plans.views import o20_missing_from_cache
from corvane.runtime import table


def test_excerpts_that_differ_late_are_two_inputs(spark, small, tmp_path):
    one = table(spark, small, "items").limit(1)
    rows = [one.withColumns({"item_id": F.lit(x), "snapshot_date": F.lit("2025-11-04").cast(one.schema["snapshot_date"].dataType), "excerpt": F.lit("a" * 1200 + x)}) for x in "bc"]
    rows[0].unionByName(rows[1]).write.parquet(f"{tmp_path}/items.parquet")
    table(spark, small, "snapshots").write.parquet(f"{tmp_path}/snapshots.parquet")
    assert o20_missing_from_cache(spark, str(tmp_path)).first()["missing"] == 2
