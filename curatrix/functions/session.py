"""Lineage cuts in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where it is unset and the session is one machine's."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint, so that lost executors cost no more than a reread.

    Spark keeps the estimated size of what was cut off, for joins a product. Cut off and joined again and again, the number's digits multiply
    until they fill the driver. Beyond 63 bits, where it says nothing, it is dropped for Spark's own size of unknown tables.
    """
    checkpoint_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    cut = out._jdf.queryExecution().analyzed()
    if cut.stats().sizeInBytes() < 1 << 63:
        return out
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(cut.rdd(), out._jdf.schema(), False), df.sparkSession)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder and read again."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
