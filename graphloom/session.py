"""Session defaults shared by the tests, the bench and the facade."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int = 8, partitions: int | None = None, app: str = "graphloom") -> SparkSession:
    """A local session with adaptive execution on and a UTC time zone.

    On a cluster the caller's own session is used as it is; nothing in the library needs settings beyond Spark's
    defaults.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
