"""Times mean the same in every session zone."""

import pytest
from pyspark.sql import functions as F

from trackflow.functions.columns import hour_number, parse_time, time_of_day

TEXTS = ["2025-03-30 01:59:50", "2025-03-30 02:00:10", "2025-03-30 03:00:10", "2025-10-26 02:59:50", "2025-10-26 03:00:10", "bad", None]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Zurich", "Asia/Kolkata"])
def test_times_do_not_follow_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
        time = parse_time(F.col("t"))
        found = rows.select("i", F.unix_seconds(time).alias("s"), time_of_day(time).alias("d"), hour_number(time).alias("h")).orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    seconds = [r["s"] for r in found]
    assert [b - a for a, b in zip(seconds[:2], seconds[1:3])] == [20, 3600] and seconds[4] - seconds[3] == 20
    assert [r["d"] for r in found] == [t[11:] if t and t != "bad" else None for t in TEXTS]
    assert [r["h"] for r in found] == [None if s is None else s // 3600 for s in seconds]
