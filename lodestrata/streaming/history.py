"""Histories kept up to date by the stream of new commits of repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import rules
from ..operators import git

PARSED = "project string, commit bigint, is_header boolean, author string, ts bigint, path string, additions bigint, deletions bigint, batch bigint"


def keep_log(stream: DataFrame, out: str, state: str, available_now: bool = True) -> StreamingQuery:
    """Parses each batch of a ``gitlog`` stream into a folder of its own; a batch that is repeated after a failure replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        git.parsed_log(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def newest_log(spark: SparkSession, out: str, n: int = rules.TOP["commits"]) -> DataFrame:
    """The parsed lines of the ``n`` newest commits of each project, as one run over its whole log gives them.

    A later batch is newer; in a batch, commits come newest first. ``commit`` numbers
    them from the newest on.
    """
    rows = spark.read.schema(PARSED).parquet(out)
    order = W.partitionBy("project").orderBy(F.col("batch").desc(), "commit")
    kept = rows.where("is_header").select("project", "batch", "commit", F.row_number().over(order).cast("long").alias("nth")).where(F.col("nth") <= n)
    return rows.join(kept, ["project", "batch", "commit"]).select("project", F.col("nth").alias("commit"), *(c for c in rows.columns if c not in ("project", "commit", "batch")))
