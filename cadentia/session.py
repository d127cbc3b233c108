"""A session with the settings that the operators expect."""

from __future__ import annotations

import os
import sys

from pyspark import cloudpickle
from pyspark.sql import SparkSession

cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])


def session(master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, UTC, Arrow; a master only where no cluster names one."""
    b = SparkSession.builder.appName("cadentia").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master or not os.environ.get("MASTER"):
        b = b.master(master or "local[*]")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
