from pyspark.sql import functions as F

from corvane.functions import text
from corvane.plans import texts


def test_shingles_find_pairs_without_a_common_band(spark):
    base = [[f"t{n}w{k}" for k in range(9)] for n in range(60)]
    rows = [(f"{n:02}{v}", " ".join(w if v == "a" else w[:8] + ["changed"])) for n, w in enumerate(base) for v in "ab"]
    titles = spark.createDataFrame(rows, "post_id string, t string")
    keys = {}
    for r in texts._near_keys(titles).collect():
        keys.setdefault(r["post_id"], set()).add(r["band"])
    pairs = [(keys[f"{n:02}a"], keys[f"{n:02}b"]) for n in range(60)]
    banded = [a & b for a, b in pairs if any(not k.startswith("m:") for k in a & b)]
    assert len(banded) < 60 and sum(bool(a & b) for a, b in pairs) >= 59
    assert all(len(k) == 8 for k in keys.values())


def test_fingerprint_has_64_bits_and_shingles(spark):
    row = spark.range(200).select(text.simhash(F.array(F.col("id").cast("string"))).alias("m"), text.near_features(F.split(F.lit("a b c d"), " ")).alias("f"))
    assert row.where("m < 0").count() > 50 and set(row.first()["f"]) == {"a b c", "b c d", "a", "b", "c", "d"}
