"""Runs, raw records, profiles and saved shapes as tables below one folder. A run's state is its last event; nothing is rewritten.

Raw records and profiles are written by attempts, each a partition of its run. A run counts once a manifest names an attempt of it:
a file that is made only if it isn't there, so of two writers of one run the first to commit wins and the other's rows, like those
of a run that broke off, are seen by no reader. A store needs a file system that makes files exclusively, as HDFS and local disks do.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.plans.config import KindredError, OutputConfig, parse_config
from kindred.plans.project import as_json, canonical_faults, checked, projected

RUNS = "run_id string, seq long, at timestamp, status string, config string, source_count long, profile_count long, warnings array<string>"
STATES = ("partial", "completed", "failed")


def current_runs(events: DataFrame) -> DataFrame:
    """The last event of each run (run_id, at, seq, ...)."""
    last = events.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in events.columns if c != "run_id"]), F.struct("at", "seq")).alias("e"))
    return last.select("run_id", "e.*")


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str, schema: str | None = None) -> DataFrame:
        """A table; if there is none, RUN_NOT_FOUND or an empty one. A store whose folder is gone raises DATABASE_UNAVAILABLE."""
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException:
            path, fs = self._path("")
            if not fs.exists(path):
                raise KindredError("DATABASE_UNAVAILABLE", f"there is no store in {self.folder}", 503) from None
            if schema is None:
                raise KindredError("RUN_NOT_FOUND", f"there is no {name} yet", 404) from None
            return self.spark.createDataFrame([], schema)

    def note(self, run_id: str, status: str, config: OutputConfig | None = None, sources: int = 0, profiles: int = 0, warnings: list[str] = ()) -> None:
        if status not in STATES:
            raise ValueError(f"status is one of {', '.join(STATES)}")
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        row = (run_id, STATES.index(status), now, status, json.dumps(asdict(config)) if config else None, sources, profiles, list(warnings))
        self.spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")

    def start(self, config: OutputConfig | None = None) -> str:
        run_id = uuid.uuid4().hex[:24]
        self.note(run_id, "partial", config)
        return run_id

    def save_raw(self, run_id: str, raw: DataFrame, attempt: str) -> None:
        raw.withColumns({"run_id": F.lit(run_id), "attempt": F.lit(attempt)}).write.mode("append").partitionBy("run_id", "attempt").parquet(f"{self.folder}/raw_sources")

    def save_profiles(self, run_id: str, profiles: DataFrame, attempt: str) -> None:
        """Refuses a run in which two profiles have one id."""
        twice = profiles.groupBy("candidate_id").count().where("count > 1").first()
        if twice:
            raise KindredError("DUPLICATE_CANDIDATE", f"two groups have the id {twice.candidate_id}", 409)
        profiles.withColumns({"run_id": F.lit(run_id), "attempt": F.lit(attempt)}).write.mode("append").partitionBy("run_id", "attempt").parquet(f"{self.folder}/candidate_profiles")

    def save(self, run_id: str, raw: DataFrame, profiles: DataFrame) -> None:
        """Both tables of a run, or nothing that a reader sees; a run that is committed already raises DUPLICATE_CANDIDATE."""
        attempt = uuid.uuid4().hex
        self.save_raw(run_id, raw, attempt)
        self.save_profiles(run_id, profiles, attempt)
        path, fs = self._path(f"commits/{run_id}")
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if not fs.exists(path):
                raise
            raise KindredError("DUPLICATE_CANDIDATE", f"run {run_id} has been committed", 409) from e
        out.write(attempt.encode())
        out.close()

    def committed(self, run_id: str) -> str | None:
        """The attempt that counts as the run."""
        path, fs = self._path(f"commits/{run_id}")
        return (self.spark.read.text(path.toString()).first() or [None])[0] if fs.exists(path) else None

    def runs(self) -> DataFrame:
        """Newest first."""
        return current_runs(self._read("runs", RUNS)).orderBy(F.desc("at"), F.desc("seq"))

    def run(self, run_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The run, its raw records and its profiles; only the partitions of the run's committed attempt are read."""
        if not re.fullmatch("[0-9a-f]{24}", run_id):
            raise KindredError("INVALID_RUN_ID", "a run's id has 24 hexadecimal digits", 400)
        run = current_runs(self._read("runs", RUNS).where(F.col("run_id") == run_id))
        if run.isEmpty():
            raise KindredError("RUN_NOT_FOUND", run_id, 404)
        own = (F.col("run_id") == run_id) & (F.col("attempt") == (self.committed(run_id) or ""))
        return run, *(self._read(name).where(own).drop("attempt") for name in ("raw_sources", "candidate_profiles"))

    def reproject(self, run_id: str, config: OutputConfig | dict | None) -> DataFrame:
        """Stored profiles in another shape, without reading sources again."""
        if not config:
            raise KindredError("MISSING_CONFIG", "a shape is needed", 400)
        config = parse_config(config) if isinstance(config, dict) else config
        profiles = canonical_faults(self.run(run_id)[2]).where(F.size("faults") == 0).drop("faults", "run_id")
        out = projected(profiles, config)
        return checked(out, config)

    def save_config(self, name: str, config: dict) -> None:
        parse_config(config)
        row = (name, json.dumps(config), datetime.now(timezone.utc).replace(tzinfo=None))
        self.spark.createDataFrame([row], "name string, config string, created_at timestamp").coalesce(1).write.mode("append").parquet(f"{self.folder}/output_configs")

    def configs(self) -> DataFrame:
        return self._read("output_configs", "name string, config string, created_at timestamp").orderBy(F.desc("created_at"))

    def writable(self) -> bool:
        """Whether the store's folder is there or can be made."""
        path, fs = self._path("")
        try:
            return fs.mkdirs(path)
        except Py4JJavaError:
            return False

    def health(self) -> dict:
        """Whether the store's folder can be read."""
        path, fs = self._path("")
        there = fs.exists(path)
        return {"status": "UP" if there else "DEGRADED", "code": 200 if there else 503}


def json_lines(out: DataFrame, config: OutputConfig, path: str) -> None:
    as_json(out, config).write.mode("overwrite").text(path)
