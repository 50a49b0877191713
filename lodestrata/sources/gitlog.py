"""Version-control logs as a data source: ``spark.read.format("gitlog").option("path", repo)``.

``spark.readStream`` gives the commits since the last batch; offsets are the commits
that repositories were at.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .. import rules

FORMAT = "--pretty=%H%x09%an%x09%at"


class GitLog(DataSource):
    """Lines of the newest commits of a repository that the executors can reach; several paths are several partitions."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "project string, line_no bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._paths(), self._commits())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self._paths(), self._commits())

    def _paths(self) -> list[str]:
        return [p for p in self.options["path"].split(",") if p]

    def _commits(self) -> int:
        return int(self.options.get("commits", rules.TOP["commits"]))


def _git(path: str, *arguments: str) -> str:
    return subprocess.run(["git", "-C", path, *arguments], capture_output=True, text=True, errors="replace", check=True).stdout


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], commits: int):
        self.paths, self.commits = paths, commits

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        reason = "not a git work tree"
        try:
            if _git(partition.value, "rev-parse", "--is-inside-work-tree").strip() == "true":
                reason = "git log failed"
                log = _git(partition.value, "log", "--no-merges", FORMAT, "--numstat", "-n", str(self.commits), "--", ".")
                for n, line in enumerate(log.split("\n") if log.strip() else [], 1):
                    yield partition.value, n, line
                reason = None if log.strip() else "no commits found"
        except FileNotFoundError:
            reason = "git is not installed or not on PATH"
        except (OSError, subprocess.CalledProcessError):
            pass
        if reason:
            yield partition.value, 0, reason  # line 0 tells why there is no log


class _StreamReader(DataSourceStreamReader):
    """Commits between the heads of two offsets, {path: head}; a path without commits has an empty head."""

    def __init__(self, paths: list[str], commits: int):
        self.paths, self.commits = paths, commits

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.paths, "")

    def latestOffset(self) -> dict:
        return {p: self._head(p) for p in self.paths}

    @staticmethod
    def _head(path: str) -> str:
        try:
            return _git(path, "rev-parse", "--verify", "--quiet", "HEAD").strip()
        except (OSError, subprocess.CalledProcessError):
            return ""

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((p, start.get(p, ""), head)) for p, head in end.items() if head and head != start.get(p, "")]

    def read(self, partition):
        path, before, head = partition.value
        # The newest of the new ones; a head that was rewritten is left out of what is walked, not an error.
        log = _git(path, "log", "--no-merges", FORMAT, "--numstat", "-n", str(self.commits), head, *([f"^{before}"] if before else []), "--", ".")
        for n, line in enumerate(log.split("\n") if log.strip() else [], 1):
            yield path, n, line


def captured_log(spark: SparkSession, path: str, project: str) -> DataFrame:
    """A log that was saved as one text file, read in parts; ``line_no`` grows with the place in the file.

    It is the part's first byte and the lines before in the part, which are fewer than its bytes.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    nth = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return lines.select(F.lit(project).alias("project"), nth.alias("line_no"), "value")
