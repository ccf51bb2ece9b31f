"""Tables that several steps use, written once to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

#: application id -> folder, for sessions that name no shared folder
_own: dict[str, str] = {}


def kept(df: DataFrame) -> DataFrame:
    """The table, written below ``spark.checkpoint.dir`` and read back: computed once, and safe from lost executors.

    Where that setting is unset, local runs get a folder of their own; on a cluster,
    whose executors would each write to their own disk, that is an error.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        app = spark.sparkContext.applicationId
        folder = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-steps-"))
    path = f"{folder.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_merge(df: DataFrame) -> DataFrame:
    """The table, which grows with the input's rows, to be joined by sorting and merging.

    Its size is estimated from compressed files, where repeated values take almost
    nothing, so that it would be broadcast through the driver at a hundredth of what
    it takes there.
    """
    return df.hint("merge")
