from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def make_session() -> SparkSession:
    spark = (SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[8]")).appName("nivalgrid-tests")
             .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
             .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
