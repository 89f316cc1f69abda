import functools
import threading

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from riskframe.plans import models


def kept_property(spark, barrier, own):
    """Whether a local property that every thread sets at the same time is still this thread's."""
    spark.sparkContext.setLocalProperty("riskframe.test", own)
    barrier.wait()
    kept = spark.sparkContext.getLocalProperty("riskframe.test") == own
    barrier.wait()
    return kept


def test_tasks_have_local_properties_of_their_own(spark):
    """One table of properties for all threads lost Spark's execution ids: NumberFormatException, now and then."""
    barrier = threading.Barrier(4, timeout=60)
    assert all(models.concurrently([functools.partial(kept_property, spark, barrier, str(i)) for i in range(4)], 4))


def test_candidates_have_local_properties_of_their_own(spark, monkeypatch):
    df = spark.range(240).select(F.col("id").alias("sample_id"), (F.col("id") % 60).alias("item_idx"), (F.col("id") % 2).cast("int").alias("label")).withColumn("x", F.col("label") + F.pmod("sample_id", F.lit(7)) / 5)
    barrier, kept, fit = threading.Barrier(2, timeout=60), [], GBTClassifier._fit
    monkeypatch.setattr(GBTClassifier, "_fit", lambda self, rows: kept.append(kept_property(spark, barrier, str(self.getMaxDepth()))) or fit(self, rows))
    models.tune(df, ["x"], [{"maxDepth": 1, "maxIter": 1}, {"maxDepth": 2, "maxIter": 1}], n_folds=2, parallelism=2)
    assert kept == [True] * 4
