"""Folders that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``.

    Without one a local session gets a temporary folder; on a cluster, where other machines
    couldn't see it, that raises ValueError. Folders stay until their owner removes them.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veclith-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/veclith-{uuid.uuid4().hex}/{name}"


def file_system(uri: str):
    """pyarrow's file system and path for a URI of a shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
