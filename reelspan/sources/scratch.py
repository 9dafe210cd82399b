"""Where jobs write tables of their own: the shared folder that the session names."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else a folder of this machine, set here, for local masters only: on
    a cluster the tasks would write where the driver can't read, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_folder(spark: SparkSession, job: str) -> str:
    """A folder for one run of a job; whoever owns the shared folder clears it."""
    return f"{scratch_root(spark)}/{job}-{uuid.uuid4().hex[:12]}"
