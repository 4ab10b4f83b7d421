"""Tables as inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where a scan has fewer splits than cores, as one small row group has; else as they are.

    Only scans of a few splits are exchanged by it, whatever the size of the cluster.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
