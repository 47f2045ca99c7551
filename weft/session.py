"""A Spark session with the settings the engine expects."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

#: Settings that hold where neither the caller nor spark-submit gives another.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "weft", cpus: int | str | None = None, **conf: str) -> SparkSession:
    """The active session, or a new one. The caller's settings come first, then spark-submit's, then the defaults; without a master, this machine's cores and 8 shuffle partitions."""
    if "PYSPARK_GATEWAY_PORT" in os.environ:
        SparkContext._ensure_initialized()  # spark-submit's JVM, which knows its settings
    builder, given = SparkSession.builder.appName(name), SparkConf()
    settings = DEFAULTS
    if "SPARK_REMOTE" not in os.environ and (cpus or not given.contains("spark.master")):
        builder = builder.master(f"local[{cpus or '*'}]")
        settings = settings | {"spark.sql.shuffle.partitions": "8"}
    settings = {k: v for k, v in settings.items() if not given.contains(k)}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting for as long as a job runs."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)
