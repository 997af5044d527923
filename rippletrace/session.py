"""Session settings the operators are designed for."""

from __future__ import annotations


def recommended_conf() -> dict[str, str]:
    """Settings to pass to ``SparkSession.builder.config``.

    Skewed join sides are split by AQE, small sides are broadcast only below the
    measured threshold, and shuffle partitions are merged at run time, so a high
    partition count is the safe default on a cluster.
    """
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    }
