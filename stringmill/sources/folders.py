"""The folder that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """What the cluster names in ``spark.checkpoint.dir``; where that is unset, a temporary folder of a local session.

    A session with executors elsewhere gets an error, since they would write to their own disks.
    """
    root = spark.conf.get(SETTING, None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stringmill-")
        spark.conf.set(SETTING, root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets; nothing is made there yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
