"""Where a plan's lineage is cut: the shared folder that the session names; and how much of it a batch holds."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder for checkpoints. Only where one machine does all the work is an own one made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """``df``, in a session whose Arrow batches hold ``most`` bytes at most: texts are long, and each task holds several copies of a batch.

    The plan runs later, under the session's setting, so the setting stays lowered; one that is lower already stays as it is.
    """
    conf = df.sparkSession.conf
    now = conf.get(_BATCH_BYTES)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > most:
        conf.set(_BATCH_BYTES, str(most))
    return df
