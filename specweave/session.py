"""Sessions with the settings that the operators are written for."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession


class Stages:
    """Wall times of named stages; a name may be used once."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextlib.contextmanager
    def stage(self, name: str) -> Iterator[None]:
        if name in self.seconds:
            raise ValueError(f"stage {name} was timed before")
        began = time.perf_counter()
        self.seconds[name] = 0.0
        try:
            yield
        finally:
            self.seconds[name] = time.perf_counter() - began


def session(master: str | None = None, name: str = "specweave", **conf: str) -> SparkSession:
    """Adaptive execution, UTC and Arrow; on a cluster set spark.checkpoint.dir to a shared folder."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
