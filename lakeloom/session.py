"""Session factory with layered settings.

Layers, later ones winning: store, table format, performance, event log, logging, explicit.
A defaults file only fills what no layer has set.
"""

from __future__ import annotations

import tempfile
import zipfile
from dataclasses import dataclass, field
from enum import Enum
from pathlib import Path

from pyspark.sql import SparkSession


class Mode(Enum):
    LOCAL = "local"
    CLASSIC = "classic"
    CONNECT = "connect"


@dataclass(frozen=True)
class Store:
    """An S3-like object store; nothing is set without an endpoint."""

    endpoint: str | None = None
    access_key: str | None = None
    secret_key: str | None = None
    path_style: bool = True

    def conf(self) -> dict[str, str]:
        if not self.endpoint:
            return {}
        found = {
            "spark.hadoop.fs.s3a.endpoint": self.endpoint,
            "spark.hadoop.fs.s3a.path.style.access": str(self.path_style).lower(),
            "spark.hadoop.fs.s3a.access.key": self.access_key,
            "spark.hadoop.fs.s3a.secret.key": self.secret_key,
        }
        return {k: v for k, v in found.items() if v is not None}


@dataclass(frozen=True)
class Tables:
    """Where managed tables live, and how partitions are overwritten."""

    warehouse: str | None = None

    def conf(self) -> dict[str, str]:
        found = {"spark.sql.sources.partitionOverwriteMode": "dynamic"}
        return found | ({"spark.sql.warehouse.dir": self.warehouse} if self.warehouse else {})


@dataclass(frozen=True)
class Performance:
    """Adaptive execution and sizes; partitions are left to AQE unless given."""

    shuffle_partitions: int | None = None
    advisory_partition: str = "128m"
    broadcast_threshold: str = "10m"
    file_partition: str = "128m"

    def conf(self) -> dict[str, str]:
        found = {
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.coalescePartitions.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": self.advisory_partition,
            "spark.sql.autoBroadcastJoinThreshold": self.broadcast_threshold,
            "spark.sql.files.maxPartitionBytes": self.file_partition,
            "spark.sql.execution.arrow.pyspark.enabled": "true",
            "spark.sql.session.timeZone": "UTC",
        }
        return found | ({"spark.sql.shuffle.partitions": str(self.shuffle_partitions)} if self.shuffle_partitions else {})


@dataclass(frozen=True)
class EventLog:
    folder: str | None = None

    def conf(self) -> dict[str, str]:
        return {"spark.eventLog.enabled": "true", "spark.eventLog.dir": self.folder} if self.folder else {}


@dataclass(frozen=True)
class Logging:
    """A Log4j 2 file for the driver's and the executors' own logs; a server's, over Connect, are its own affair."""

    file: str | None = None

    def conf(self) -> dict[str, str]:
        option = f"-Dlog4j2.configurationFile={self.file}"
        return {"spark.driver.extraJavaOptions": option, "spark.executor.extraJavaOptions": option} if self.file else {}


def defaults_file(path: str) -> dict[str, str]:
    """``key value`` lines; comments and blank lines are skipped, a later line of a key wins."""
    out = {}
    for line in Path(path).read_text().splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            key, _, value = line.replace("=", " ", 1).partition(" ")
            out[key] = value.strip()
    return out


@dataclass(frozen=True)
class Settings:
    store: Store = field(default_factory=Store)
    tables: Tables = field(default_factory=Tables)
    performance: Performance = field(default_factory=Performance)
    event_log: EventLog = field(default_factory=EventLog)
    logging: Logging = field(default_factory=Logging)
    defaults: str | None = None

    def resolved(self, explicit: dict[str, str] | None = None) -> dict[str, str]:
        layers = [defaults_file(self.defaults) if self.defaults else {}, self.store.conf(), self.tables.conf(), self.performance.conf(), self.event_log.conf(), self.logging.conf(), explicit or {}]
        out: dict[str, str] = {}
        for layer in layers:
            out |= {k: str(v) for k, v in layer.items()}
        return out


def create_session(app: str, mode: str | Mode = Mode.LOCAL, master: str | None = None, settings: Settings | None = None, **explicit: str) -> SparkSession:
    """A session for ``mode``; unknown modes raise ValueError.  Keyword settings use ``__`` for dots."""
    mode = Mode(mode)
    conf = (settings or Settings()).resolved({k.replace("__", "."): v for k, v in explicit.items()})
    builder = SparkSession.builder.appName(app)
    if mode is Mode.CONNECT:
        builder = builder.remote(master or "sc://localhost:15002")
    else:
        builder = builder.master(master or ("local[*]" if mode is Mode.LOCAL else "spark://localhost:7077"))
    return builder.config(map=conf).getOrCreate()


def archive(folder: str, target: str) -> str:
    """A zip of a package folder's Python files, under the package's name; equal files give an equal archive."""
    root = Path(folder).resolve()
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.writestr(zipfile.ZipInfo(str(Path(root.name) / path.relative_to(root))), path.read_bytes())
    return target


def ship(spark: SparkSession, folder: str) -> str:
    """Send a package to where user functions run, a Connect server included; the archive's path."""
    target = archive(folder, str(Path(tempfile.mkdtemp(prefix="lakeloom-code-")) / f"{Path(folder).resolve().name}.zip"))
    context = getattr(spark, "_sc", None)
    if context is not None:
        context.addPyFile(target)
    else:
        spark.addArtifact(target, pyfile=True)
    return target
