"""The shared folder of the cluster, for written stage tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_FALLBACK: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor can reach.

    Where it is unset, a temporary folder serves a local master; on a cluster that is an
    error, as each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _FALLBACK:
            _FALLBACK[application] = "file://" + tempfile.mkdtemp(prefix="corridorwatch-")
        root = _FALLBACK[application]
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
