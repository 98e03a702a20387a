"""Session defaults, and the shared folder for anything written mid-job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Merge sessions inside each map task before they are shuffled.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # State lives on disk next to the executor, with changelogs in the checkpoint.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # A join of two streams has one store per partition, not four.
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def build(app: str = "fleetlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above. ``conf`` keys use ``__`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the cluster's shared ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a folder of
    its own under the machine's temporary directory.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        app = context.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="fleetlens-")
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
