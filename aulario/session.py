"""Session settings and the reference instant used by tests and registered queries."""

from __future__ import annotations

import datetime as dt
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

#: Instant at which the registered queries are evaluated (start of slot 5 of that day).
AS_OF = dt.datetime(2025, 2, 1, 12, 0, 0)

# Only runtime SQL settings: they can be applied to a session somebody else built. Shuffle
# parallelism is left to the cluster; AQE coalesces what is too fine and splits what is too big.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One id may carry a third of a table: split such partitions even at the price of a shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings every operator relies on."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def build_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; its scratch folder is temporary unless one is configured."""
    builder = SparkSession.builder
    if not SparkConf().contains("spark.checkpoint.dir"):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="aulario-"))
    spark = (
        builder.master(f"local[{cores}]")
        .appName("aulario")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # plans here are built from hundreds of small column calls; record no stack for each
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
