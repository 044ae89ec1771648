"""Cutting plans that grow with each iteration, and broadcasts behind a check of their size."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``. Only a local session
    without the setting, as in tests on one machine, gets a folder of its own; a cluster without it is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if folder is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or os.path.join(tempfile.gettempdir(), "terrazzo-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared checkpoint folder, which outlives the executors.

    The estimated size is forgotten too: a checkpoint keeps that of its plan, a product over joins, so that in a loop its
    digits, and the time to plan a round, double with each round. Joins choose their form by sizes at run time.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    done, session = df.checkpoint(), df.sparkSession
    plain = session._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    return DataFrame(plain, session)


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df, marked for broadcast if its rows, which are counted unless their number is given, fit the bound."""
    return F.broadcast(df) if (df.count() if rows is None else rows) * row_bytes <= BROADCAST_BYTES else df
