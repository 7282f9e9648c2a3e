"""A store's commits as a streaming source: offsets are commit versions, partitions are data files of new commits."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from strandlog.schema import EVENT
from strandlog.sources.files import Files

FORMAT = "strandlog_commits"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class CommitReader(DataSourceStreamReader):
    """Reads the events of commits in (start, end]; snapshots repeat events and are passed over.

    Options: path; startVersion (commits up to it are not read); maxCommits to a batch.
    """

    def __init__(self, options: dict[str, str]):
        self.files = Files(options["path"])
        self.start = int(options.get("startversion", options.get("startVersion", "0")))
        self.most = int(options.get("maxcommits", options.get("maxCommits", "1000")))
        self.last = self.start

    def initialOffset(self) -> dict:
        return {"version": self.start}

    def latestOffset(self) -> dict:
        names = self.files.list("_commits")
        newest = max([self.start, *(int(n.rsplit("/", 1)[-1][:-5]) for n in names if n.endswith(".json"))])
        self.last = min(newest, self.last + self.most)
        return {"version": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = max(self.last, end["version"])
        out = []
        for v in range(start["version"] + 1, end["version"] + 1):
            record = json.loads(self.files.read(f"_commits/{v:012d}.json"))
            if record["folder"] and record["kind"] != "snapshot":
                out += [_File(p) for p in self.files.list(f"data/{record['folder']}", recursive=True) if p.endswith(".parquet")]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in EVENT.fields]
        with self.files.fs.open_input_file(f"{self.files.base}/{partition.path}") as f:
            for batch in pq.ParquetFile(f).iter_batches():
                yield batch.select(names)

    def commit(self, end: dict) -> None:
        pass


class CommitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return EVENT

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return CommitReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CommitSource)


def commit_stream(spark: SparkSession, path: str, start_version: int = 0, max_commits: int = 1000):
    """A streaming DataFrame of a store's appended events, commit by commit."""
    register(spark)
    return spark.readStream.format(FORMAT).option("path", path).option("startVersion", start_version).option("maxCommits", max_commits).load()


