"""Steps that grow with the elements stay in the JVM, or go through Python once."""

from conftest import DATA
from pyspark.sql import functions as F

from radiolith.operators import deident, views
from radiolith.plans import bridge
from radiolith.sources import reader

FIELDS = "object_id string, path string, ord int, tag string, vr string, item_count int, raw binary, value string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_text_of_parsed_files_is_decoded_by_the_parser(spark):
    assert "ArrowEvalPython" not in plan(reader.elements(spark.createDataFrame([], reader.FILE)))


def test_deidentification_goes_through_python_once(spark):
    got = plan(deident.deidentify(spark.createDataFrame([], FIELDS).withColumn("raw", F.col("raw")))[0])
    assert got.count("ArrowEvalPython") == 1 and "array_compact" not in got and "filter(array(" not in got.lower()


def test_views_of_images_shuffle_once_and_by_the_size_of_the_input(spark):
    rows = bridge.images(spark, DATA)
    for view in (views.series_view, views.image_view):
        got = view(rows)._jdf.queryExecution().executedPlan().toString()
        assert got.count("Exchange hashpartitioning") == 1
        splits = bridge.table(spark, DATA, "lineitem").rdd.getNumPartitions()
        assert f", {bridge.TASKS_A_SPLIT * splits}), REPARTITION_BY_NUM" in got
