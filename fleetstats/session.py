"""Session settings and the shared folder."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# What the jobs expect of a session.  Sizes are left to AQE, which coalesces small shuffle
# partitions and splits skewed ones at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split generated code beyond what the JVM compiles; wide reports run twice as fast.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Streamed sessions are merged before the shuffle: a busy host sends its sessions, not its messages.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

_local_folders: dict[str, str] = {}


def build_session(app: str = "fleetstats", master: str | None = None, **settings: str) -> SparkSession:
    """A session with ``SETTINGS``; keyword arguments use ``__`` for the dots of a setting's name."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    A local session that names none gets a temporary one of its own.  A cluster session must name
    one, because a folder on one machine is out of reach of the executors on the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = context.applicationId
    if key not in _local_folders:
        _local_folders[key] = tempfile.mkdtemp(prefix="fleetstats-")
    return _local_folders[key]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a session whose machines do not have it installed."""
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="fleetstats-ship-"), "fleetstats"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    spark.sparkContext.addPyFile(archive)
