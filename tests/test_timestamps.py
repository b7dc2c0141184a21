from datetime import datetime, timezone

import pytest

from corvane.operators.timestamps import with_utc_micros


def us(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1_000_000)


CASES = [
    ("2025-10-24T07:35:07Z", None, None, us(2025, 10, 24, 7, 35, 7)),
    ("2025-10-24 10:51:05+1100", None, None, us(2025, 10, 23, 23, 51, 5)),
    ("2025-10-23T20:10:35.668172926Z", None, None, us(2025, 10, 23, 20, 10, 35, 668172)),
    ("20251024T032544Z", None, None, us(2025, 10, 24, 3, 25, 44)),
    ("1761276408", None, None, 1761276408_000000),
    ("1761276408.25", None, None, 1761276408_250000),
    ("1761251642226", None, None, 1761251642226_000),
    ("1761151283409172", None, None, 1761151283409172),
    ("1761151283409172999", None, None, 1761151283409172),
    ("Thu, 23 Oct 2025 12:40:40 GMT", None, None, us(2025, 10, 23, 12, 40, 40)),
    ("Fri Oct 24 03:10:19 GMT 2025", None, None, us(2025, 10, 24, 3, 10, 19)),
    ("10/23/2025 3:46 PM", "America/New_York", "MDY", us(2025, 10, 23, 19, 46)),
    ("02/10/2025 09:22", "Europe/Madrid", "DMY", us(2025, 10, 2, 7, 22)),
    ("02/10/2025 09:22", None, None, None),
    ("24.10.2025 01:25", "Europe/Berlin", "DMY", us(2025, 10, 23, 23, 25)),
    ("29. Oktober 2025, 08:56 Uhr", "Europe/Berlin", "DMY", us(2025, 10, 29, 7, 56)),
    ("23 octobre 2025 à 21h00", "Europe/Paris", "DMY", us(2025, 10, 23, 19)),
    ("28 октября 2025, 07:32", "Europe/Moscow", "DMY", us(2025, 10, 28, 4, 32)),
    ("1 de noviembre de 2024, 03:50", "Europe/Madrid", "DMY", us(2024, 11, 1, 2, 50)),
    ("Oct 24, 2025 5:42 PM EDT", "America/Los_Angeles", "MDY", us(2025, 10, 24, 21, 42)),
    ("October 24, 2025, 12:39 am", None, None, us(2025, 10, 24, 0, 39)),
    ("2025-10-23T21:03:35 America/Chicago", "Asia/Tokyo", None, us(2025, 10, 24, 2, 3, 35)),
    ("2025-10-23T18:27:58-05:00[America/Chicago]", None, None, us(2025, 10, 23, 23, 27, 58)),
    ("2025-10-26 02:30:00", "Europe/Berlin", None, us(2025, 10, 26, 0, 30)),  # twice that night: the first
    ("2025-03-30 02:30:00", "Europe/Berlin", None, us(2025, 3, 30, 1, 30)),  # skipped: moves on
    ("2024-12-13", "Asia/Tokyo", "YMD", us(2024, 12, 12, 15)),
    *((bad, "Europe/Berlin", "DMY", None) for bad in ("", "-", "n/a", "yesterday", "2025-13-45T27:61:00Z", "0000-00-00 00:00:00", "2025-02-30", "31/02/2025 10:00", "x" * 5000, "2025-10-24T07:35:07 Nowhere/Land", "2025-10-24 07:35 XYZ")),
    (None, None, None, None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_readings(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, t string, z string, o string")
        found = {r["i"]: r["utc_us"] for r in with_utc_micros(df, "t", "z", "o").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [(CASES[i][0], v) for i, v in sorted(found.items())] == [(c[0], c[3]) for c in CASES]


def test_empty_table(spark):
    assert with_utc_micros(spark.createDataFrame([], "t string, z string, o string"), "t", "z", "o").count() == 0
