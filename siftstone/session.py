"""Session defaults for local runs; a cluster supplies its own configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> None:
    """Bound the bytes of an Arrow batch in this session, unless it has a bound of its own: long texts come in few rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    df.sparkSession.conf.set(key, df.sparkSession.conf.get(key, str(BATCH_BYTES)))


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local[cpus] session with the engine's defaults."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("siftstone")
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory}
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
