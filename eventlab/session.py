"""Session helpers: a local builder for tests/bench and the shared stage folder.

On a cluster the stage folder is the one the cluster names in
``spark.checkpoint.dir`` (a shared file system); a local temporary folder is
only chosen when that setting is unset and the master is local.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "eventlab", cpus: str | int = "*", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    """Local session with AQE on, UI off and UTC session time."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stage tables.

    Reads ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only when
    both are unset and the master is local (tests, bench) a fresh temporary
    folder is created and registered.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="eventlab-ckpt-")
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path for one stage table under the shared folder."""
    return os.path.join(checkpoint_root(spark), "stage", f"{name}-{uuid.uuid4().hex[:12]}")


def size_for_input(spark: SparkSession, input_bytes: int, partition_bytes: int = 256 << 20,
                   min_partitions: int = 200) -> dict:
    """Spill-aware sizing for a run over ``input_bytes`` of input:
    ~``partition_bytes`` per scan split and per shuffle partition (AQE
    coalesces small ones and splits skewed ones at run time). Settings the
    session already carries explicitly are left alone; returns what was set."""
    n_parts = max(min_partitions, -(-input_bytes // partition_bytes))
    wanted = {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(n_parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes * 2),
    }
    applied = {}
    explicit = dict(spark.sparkContext.getConf().getAll())
    for k, v in wanted.items():
        if k not in explicit:
            spark.conf.set(k, v)
            applied[k] = v
    return applied
