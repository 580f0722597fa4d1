"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder the cluster names in spark.checkpoint.dir.

    Where none is named, a local session (tests) gets a temporary folder that is removed at exit; on a cluster a folder
    of one machine would be lost with it, so that is refused.  Set spark.cleaner.referenceTracking.cleanCheckpoints to
    have what is no longer referred to removed while the session goes on.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        named = tempfile.mkdtemp(prefix="postloom-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and returns a frame that reads it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
