from pyspark.sql import functions as F

from lodestone.operators import draws


def test_draws_are_dealt_among_tasks(spark):
    weights = draws.cluster_weights(spark.range(50).select(F.col("id").alias("c")), "c", 4, 1)
    assert weights._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
    assert [r.n for r in weights.groupBy("draw").agg(F.sum("weight").alias("n")).collect()] == [50] * 4
