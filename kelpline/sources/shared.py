"""The session's own folders on a shared store: where lineage is cut and tables of its own go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, else the warehouse; driver and executors share both."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that a lost executor recomputes nothing before it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
