"""Each document is parsed once, files and plans are made in several tasks."""

from sigmaspark.plans import measure, watch
from sigmaspark.plans.fixtures import spread
from sigmaspark.sources import products


def test_noise_is_parsed_once(spark):
    rows = spark.createDataFrame([("s", "<n><adsHeader><polarisation>VH</polarisation></adsHeader></n>")], "scene string, value string")
    nodes, blocks = products.noise_nodes(rows)
    for df in (nodes, blocks, products.calibration_nodes(rows)):
        assert "from_xml" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert df.count() == 0


def test_plans_are_made_in_several_tasks(spark, tmp_path):
    spark.range(40).selectExpr("id as p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(40).selectExpr("id as c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert "RoundRobinPartitioning" in measure.w13(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert spread(spark.range(40).coalesce(1)).rdd.getNumPartitions() > 4
    assert watch.s05(spark, str(tmp_path)).count() == 40
