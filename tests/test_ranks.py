import random

from pyspark.sql import functions as F

from corvane.operators.ranks import numbered


def test_numbers_equal_a_sort(spark):
    rng = random.Random(1)
    rows = [(f"k{k:04}", rng.choice([None, 1, 2, 2, 3])) for k in range(700)]
    df = spark.createDataFrame(rows, "id string, v int").repartition(5)
    found = {r["id"]: r["n"] for r in numbered(df, [F.desc_nulls_last("v"), F.col("id")]).collect()}
    expected = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert found == {r[0]: k + 1 for k, r in enumerate(expected)}
    assert numbered(df.limit(0), [F.col("id")]).count() == 0
