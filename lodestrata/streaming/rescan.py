"""Incremental rescans: a stream of changed files keeps line counts and totals up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import rules
from ..operators.files import as_files, with_line_counts


def changed_files(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Line counts of a stream of (project, path, content, changed_at); a version that comes twice within the watermark counts once."""
    once = stream.withColumn("version", F.sha2("content", 256)).withWatermark("changed_at", late).dropDuplicatesWithinWatermark(["project", "path", "version"])
    fits = F.octet_length("content") <= rules.MAX_FILE_BYTES  # as in a scan of the tree
    counted = with_line_counts(as_files(once.where(fits)))
    return counted.select("project", "path", "language", "lines", "blank", "comment", "code")


def activity(stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Changed files of each project in windows of time."""
    rows = stream.withWatermark("changed_at", late).groupBy("project", F.window("changed_at", width).alias("at"))
    return rows.agg(F.count("*").alias("changes"), F.approx_count_distinct("path").alias("paths"))


def keep_up(stream: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's counts as a partition of a table; ``latest`` reads its newest rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch that is tried again replaces its own rows.
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    return changed_files(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(table: DataFrame) -> DataFrame:
    """The newest counts of each path."""
    columns = [c for c in table.columns if c not in ("project", "path", "batch")]
    return table.groupBy("project", "path").agg(F.max_by(F.struct(*columns), "batch").alias("x")).select("project", "path", *(F.col(f"x.{c}").alias(c) for c in columns))
