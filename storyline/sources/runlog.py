"""The log of runs as JSON lines, and counts that come with the job that makes the rows."""

from __future__ import annotations

import datetime as dt
import json
import sys
import time
from contextlib import contextmanager
from typing import TextIO

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RECORD = "timestamp string, level string, component string, source string, event string, duration double, error string"


class RunLog:
    """Events of a run, a JSON object a line (timestamp, level, component, source, event, duration, error)."""

    def __init__(self, out: TextIO | None = None):
        self.out = out

    def log(self, level: str, component: str, event: str, source: str | None = None, duration: float | None = None, error: object = None) -> dict:
        """Writes an event and returns it; an output that can't be written to costs the line, not the run."""
        record = {
            "timestamp": dt.datetime.now(dt.timezone.utc).isoformat(), "level": level.upper(), "component": component, "source": source, "event": event,
            "duration": None if duration is None else round(duration, 4), "error": None if error is None else str(error),
        }
        try:
            print(json.dumps(record, ensure_ascii=False), file=self.out or sys.stdout, flush=True)
        except (OSError, ValueError):
            pass
        return record

    @contextmanager
    def step(self, component: str, event: str, source: str | None = None):
        """Logs that a step is done, or that it failed and why, with how long it took."""
        begun = time.perf_counter()
        try:
            yield
        except Exception as e:
            self.log("error", component, f"{event}_failed", source, time.perf_counter() - begun, e)
            raise
        self.log("info", component, f"{event}_completed", source, time.perf_counter() - begun)


def records(spark: SparkSession, path: str) -> DataFrame:
    """The events of log files; lines that aren't JSON are left out."""
    rows = spark.read.schema(f"{RECORD}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").drop("_corrupt").withColumn("timestamp", F.to_timestamp("timestamp"))


def observed(rows: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """``rows`` and an observation of their number (``n``) and other aggregates.

    They are counted by the first action on the rows, while it makes them: no scan of its own.
    """
    watch = Observation()
    return rows.observe(watch, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in counts.items())), watch
