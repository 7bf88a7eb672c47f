"""Tables that are computed once and read several times."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read from there by all that follows, so that what uses it several
    times does not compute it again and a lost executor costs no more than the tasks it ran. The folder is the
    session's spark.checkpoint.dir; only on a local master, where it is unset, is a temporary one made."""
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
