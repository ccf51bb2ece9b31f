"""Session-level helpers: shared folder, written tables, sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a local one for local runs, as in tests, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        path = _own.setdefault(spark.sparkContext.applicationId, "")
        if not path:
            path = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="shelfmark-")
    return path.rstrip("/")


#: application id -> folder, for sessions without a shared folder
_own: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column, summed over all rows."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def with_fields(schema: T.StructType, ddl: str) -> T.StructType:
    """The schema with further columns at its end."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])
