"""Joins to side tables: the broadcast and the salted way give the same rows."""

import pytest
from pyspark.sql import functions as F

from trackflow.operators.tables import attach, materialise, row_count, shared_dir


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("conditional", [False, True])
def test_attach_ways_agree(spark, how, conditional):
    fact = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"))
    dim = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 100).alias("w"))
    condition = F.col("id") > F.col("w") if conditional else None
    ways = [attach(fact, dim, ["k"], how, condition, max_broadcast_rows=m) for m in (100, 0)]
    seen = [sorted(map(tuple, w.select(*sorted(w.columns)).collect()), key=repr) for w in ways]
    assert seen[0] == seen[1]
    assert len(seen[0]) > 0


def test_materialise_counts_and_reads_back(spark):
    written = materialise(spark.range(37).withColumn("d", F.col("id") / 2))
    assert row_count(written) == 37 == written.count()
    assert written.columns == ["id", "d"]
    assert row_count(materialise(spark.range(0))) == 0


def test_shared_dir_follows_the_session(spark):
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Context:
        master, applicationId = "spark://somewhere", "app"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    named, unnamed = Session(), Session()
    named.conf, unnamed.conf = Conf({"spark.checkpoint.dir": "/shared/here/"}), Conf()
    assert shared_dir(named) == "/shared/here"
    with pytest.raises(RuntimeError):
        shared_dir(unnamed)
    assert shared_dir(spark) == shared_dir(spark)
