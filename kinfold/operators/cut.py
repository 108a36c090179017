"""Where lineage ends."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SERIAL = itertools.count()


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder, not yet made, below the one all machines of the cluster share.

    The parent is the session's ``spark.checkpoint.dir``. Only where that is unset and the
    master is local, as in tests, is a temporary folder chosen and set for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="kinfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{next(_SERIAL)}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read again.

    What came before runs once, a lost executor costs no more than the tasks it was running,
    and later steps read only the columns they need.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
