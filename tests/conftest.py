from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from checks.compare import session

    made = session(memory="4g")
    yield made
    made.stop()


@pytest.fixture
def fixes(spark):
    """Builds fixes from (session, animal, 'HH:MM:SS', x, y) in order of event_id."""
    from pyspark.sql import functions as F

    def build(rows):
        table = [(i, r[0], r[1], f"2024-01-01 {r[2]}", float(r[3]), float(r[4])) for i, r in enumerate(rows)]
        kinds = "event_id long, session_id string, animal_id string, t string, x double, y double"
        made = spark.createDataFrame(table, kinds).withColumn("time", F.to_timestamp("t")).drop("t")
        return made.withColumns({"breed": F.substring("animal_id", 1, 2), "nsat": F.lit(9), "hour": F.hour("time")})

    return build
