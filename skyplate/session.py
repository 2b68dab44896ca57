"""Session settings the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC. ANSI mode stays on: operators use try_ functions where text may not parse.

    On a cluster leave master and shuffle_partitions unset: the former comes from spark-submit, and for the latter a
    high initial number is coalesced by adaptive execution to partitions of the advisory size.
    """
    builder = SparkSession.builder.appName("skyplate")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings | conf).getOrCreate()


def tasks(df: DataFrame) -> int:
    """Tasks that work is dealt over whose rows are few and whose pairs are many: adaptive execution, which goes by bytes, would put it into one."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism
