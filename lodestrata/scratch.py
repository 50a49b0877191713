"""Tables written once in the folder that every machine of the cluster shares.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset and
Spark runs on a single machine, as in tests, a local default is used. A written
table cuts the lineage and survives the loss of any executor.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_DEFAULT = "file:///tmp/checkpoints/lodestrata"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = LOCAL_DEFAULT
    return f"{base.rstrip('/')}/lodestrata/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark drops the shuffle files of a query that ends in here; else they stay until the driver's garbage is collected."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


def stored(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again; told so, what was shuffled for it is dropped then."""
    path = shared_path(df.sparkSession, name)
    with _dropping_shuffles(df.sparkSession) if drop_shuffles else nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows.

    Beyond that it comes back without a hint, and the join shuffles. Pass a
    stored table: its rows are counted.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df

