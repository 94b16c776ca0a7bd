"""A6 as a polled source: transaction records of append-only shards, a bounded number of each per poll.

A shard is a file of JSON lines that only grows. An offset holds for each shard the bytes that have been read, so a restarted
query goes on behind the last record of its checkpoint. A new query starts at the ends of the shards (``latest``) or at their
beginnings (``earliest``); a shard that appears later is read from its beginning. A poll takes at most ``records`` whole
lines of each shard; a line without its end yet waits for a later poll.

The driver finds where the next ``records`` lines of each shard end by counting line ends in the bytes; the lines themselves
are read and parsed by tasks. A poll of many shards is dealt over at most ``tasks`` of them, in parts of about equal bytes, so
a poll costs its records and not a task and an output file for each shard. When a query is restarted, Spark first plans the last batch of its log again, which tells
the reader where to go on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .replay import STREAM_TX

RECORDS = 100           # fixed value: records of a shard per poll
PIECE = 1 << 16         # bytes read at a time
TASKS = 8               # tasks of a poll; read_shards gives two for each core if that is more
BATCH = 10_000          # rows handed to Spark at a time


ROW = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[f.dataType.simpleString()]) for f in STREAM_TX.fields])


def _opened(path: str):
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, root.rstrip("/")


def _batch(rows: list[dict]) -> pa.RecordBatch:
    text = lambda v: v if v is None or isinstance(v, str) else str(v)
    values = ([text(r.get(f.name)) if pa.types.is_string(f.type) else r.get(f.name) for r in rows] for f in ROW)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, ROW, strict=True)], schema=ROW)


class Lines(InputPartition):
    """Shards with their bytes ``begin`` to ``end``, read by one task."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        super().__init__(parts)
        self.parts = parts


class ShardReader(DataSourceStreamReader):
    def __init__(self, path: str, records: int, starting: str, tasks: int):
        self.path, self.records, self.starting, self.tasks = path, records, starting, tasks
        self.polled: dict | None = None

    def shards(self) -> dict[str, int]:
        """Sizes of the shards by name; hidden files and marks of writers are none."""
        from pyarrow import fs

        system, root = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(root))
        return {f.base_name: f.size for f in sorted(found, key=lambda f: f.base_name) if f.is_file and f.base_name[0] not in "._"}

    def end_of(self, system, shard: str, begin: int) -> int:
        """Where the next ``records`` whole lines of a shard end, or all of them if there are fewer."""
        left, at, end = self.records, begin, begin
        with system.open_input_file(shard) as f:
            f.seek(begin)
            while left and (piece := f.read(PIECE)):
                ends = np.flatnonzero(np.frombuffer(piece, np.uint8) == 10)[:left]
                if len(ends):
                    end = at + int(ends[-1]) + 1
                left, at = left - len(ends), at + len(piece)
        return end

    def initialOffset(self) -> dict:
        return {k: size if self.starting == "latest" else 0 for k, size in self.shards().items()}

    def latestOffset(self) -> dict:
        if self.polled is None:
            self.polled = self.initialOffset()
        system, root = _opened(self.path)
        self.polled = self.polled | {k: self.end_of(system, f"{root}/{k}", self.polled.get(k, 0))
                                     for k, size in self.shards().items() if size > self.polled.get(k, 0)}
        return self.polled

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        if self.polled is None:                         # a restart: the last batch that was planned
            self.polled = end
        parts = [(k, start.get(k, 0), upto) for k, upto in sorted(end.items()) if upto > start.get(k, 0)]
        share = sum(upto - begin for _, begin, upto in parts) / self.tasks
        dealt, held = {}, 0
        for part in parts:
            dealt.setdefault(int(held / share), []).append(part)
            held += part[2] - part[1]
        return [Lines(p) for p in dealt.values()]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        system, root = _opened(self.path)
        rows = []
        for shard, begin, end in partition.parts:
            with system.open_input_file(f"{root}/{shard}") as f:
                f.seek(begin)
                rows += [json.loads(line) for line in f.read(end - begin).split(b"\n") if line.strip()]
            while len(rows) >= BATCH:
                yield _batch(rows[:BATCH])
                rows = rows[BATCH:]
        if rows:
            yield _batch(rows)

    def commit(self, end: dict) -> None:
        pass


class ShardSource(DataSource):
    """Options: ``path`` of the folder of shards, ``records`` per shard and poll, ``starting`` latest | earliest, ``tasks`` per poll."""

    @classmethod
    def name(cls) -> str:
        return "transaction_shards"

    def schema(self):
        return STREAM_TX

    def streamReader(self, schema) -> ShardReader:
        starting = self.options.get("starting", "latest")
        if starting not in ("latest", "earliest"):
            raise ValueError(f"starting is latest or earliest, not {starting!r}")
        return ShardReader(self.options["path"], int(self.options.get("records", RECORDS)), starting, int(self.options.get("tasks", TASKS)))


def read_shards(spark: SparkSession, path: str, records: int = RECORDS, starting: str = "latest") -> DataFrame:
    """The records of a folder of shards as a stream."""
    from ..session import ship_package
    ship_package(spark)
    spark.dataSource.register(ShardSource)
    tasks = max(TASKS, 2 * spark.sparkContext.defaultParallelism)
    return (spark.readStream.format(ShardSource.name()).option("path", path).option("records", str(records)).option("starting", starting)
                 .option("tasks", str(tasks)).load()
                 .withColumn("event_time", F.timestamp_seconds("unix_time")))


def write_shards(tx: DataFrame, path: str, shards: int) -> None:
    """Label-free records as ``shards`` files of JSON lines: all of a card in one, in (time, tie) order."""
    x = tx.select(*[(F.col(f.name) if f.name in tx.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in STREAM_TX.fields])
    x.repartition(shards, "cc_num").sortWithinPartitions("unix_time", "tie").write.mode("append").json(path)
