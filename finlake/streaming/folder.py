"""Stream of event files with a start position, a rate limit and a policy for lost files.

``event_files`` is a streaming data source over a folder whose files are
complete when they appear and whose names grow, as rotated logs do. An offset
is the name of the last file read and the number of files in its batch, so a
stream holds one short position whatever the folder holds.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from finlake.streaming.events import read_events

STARTS = ("earliest", "latest")
# Read from a file at a time; a line may be longer.
BLOCK_BYTES = 1 << 22
# Number of files of a batch whose start Spark did not tell.
UNKNOWN = -1


class LostFiles(Exception):
    """Files of a batch are gone and the stream must not go on without them."""


class EventFile(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class EventFileReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("event_files needs a path")
        self.uri = options["path"]
        self.starting = options.get("startingoffsets", "latest")
        if self.starting not in STARTS:
            raise ValueError(f"startingOffsets: {self.starting} is none of {', '.join(STARTS)}")
        self.limit = int(options.get("maxfilespertrigger", 0))
        if self.limit < 0:
            raise ValueError("maxFilesPerTrigger is negative")
        self.kept_at = options.get("positionpath")
        if self.limit and not self.kept_at:
            raise ValueError("maxFilesPerTrigger needs a positionPath of the query's own")
        self.strict = options.get("failondataloss", "true").lower() == "true"
        self.initial: dict | None = None
        self.position: dict | None = None

    @staticmethod
    def _located(uri: str) -> tuple[fs.FileSystem, str]:
        if uri.startswith("file:"):
            uri = "/" + uri.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)

    def _names(self) -> list[str]:
        system, path = self._located(self.uri)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))

    def initialOffset(self) -> dict:
        if self.initial is None:
            names = self._names() if self.starting == "latest" else []
            self.initial = {"last": names[-1] if names else "", "files": 0}
        return self.initial

    def _stored(self) -> dict | None:
        system, path = self._located(self.kept_at)
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with system.open_input_stream(path, compression=None) as stream:
            return json.loads(stream.read())

    def _keep(self, position: dict) -> None:
        system, path = self._located(self.kept_at)
        system.create_dir(posixpath.dirname(path))
        with system.open_output_stream(f"{path}.new", compression=None) as stream:
            stream.write(json.dumps(position).encode())
        system.move(f"{path}.new", path)

    def latestOffset(self) -> dict:
        """The last file there, or that which the limit allows after the position.

        Spark asks for this before it tells a new or restarted source its
        start, so a limit needs the position kept at ``positionPath``. It is
        written when a batch is planned, after Spark logged its end.
        """
        if self.position is None and self.kept_at:
            self.position = self._stored() or self.initialOffset()
        names = self._names()
        if self.position is None:
            return {"last": names[-1] if names else "", "files": UNKNOWN}
        waiting = [n for n in names if n > self.position["last"]]
        batch = waiting[:self.limit] if self.limit else waiting
        if batch:
            self.position = {"last": batch[-1], "files": len(batch)}
        return self.position

    def partitions(self, start: dict, end: dict) -> Sequence[EventFile]:
        names = [n for n in self._names() if start["last"] < n <= end["last"]]
        gone = end["files"] - len(names)
        if self.strict and start != end and gone > 0:
            raise LostFiles(f"{gone} files up to {end['last']} are gone")
        if self.position is None or self.position["last"] < end["last"]:
            self.position = dict(end)
        if self.kept_at:
            self._keep(end)
        return [EventFile(n) for n in names]

    def read(self, partition: EventFile) -> Iterator[pa.RecordBatch]:
        """Lines of a file, a block at a time. A file that went after the batch was planned is lost or left out."""
        system, path = self._located(self.uri)
        try:
            stream = system.open_input_stream(posixpath.join(path, partition.name), compression=None)
        except FileNotFoundError:
            if self.strict:
                raise LostFiles(f"{partition.name} is gone") from None
            return
        with stream:
            rest = b""
            while block := stream.read(BLOCK_BYTES):
                *lines, rest = (rest + block).split(b"\n")
                yield self._batch(lines, partition.name)
            if rest:
                yield self._batch([rest], partition.name)

    @staticmethod
    def _batch(lines: list[bytes], name: str) -> pa.RecordBatch:
        values = pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())
        return pa.record_batch([values, pa.array([name] * len(lines), pa.string())], names=["value", "file"])


class EventFiles(DataSource):
    """Options: path, startingOffsets (latest, earliest), maxFilesPerTrigger with positionPath, failOnDataLoss (true, false).

    ``positionPath`` is a file of one query, best beside its checkpoint, and goes when that goes.
    """

    @classmethod
    def name(cls) -> str:
        return "event_files"

    def schema(self) -> str:
        return "value string, file string"

    def streamReader(self, schema) -> EventFileReader:
        return EventFileReader({k.lower(): v for k, v in self.options.items()})


def stream_folder(spark: SparkSession, path: str, starting: str = "latest", per_trigger: int | None = None,
                  position: str | None = None, fail_on_data_loss: bool = False) -> DataFrame:
    """Raw lines (value, file) of a folder of event files, with the defaults of :func:`events.message_source`."""
    spark.dataSource.register(EventFiles)
    reader = spark.readStream.format("event_files").option("startingOffsets", starting).option(
        "failOnDataLoss", str(fail_on_data_loss).lower())
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if position:
        reader = reader.option("positionPath", position)
    return reader.load(path)


def read_folder(spark: SparkSession, path: str, **options) -> DataFrame:
    """Event stream of a folder of event files."""
    return read_events(stream_folder(spark, path, **options))
