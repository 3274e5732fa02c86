"""An event sink that takes each micro-batch once, as a Python data source.

A task writes its rows, in order of session and step, to a file of its own under `parts`, and tells its name. The commit lists the names of a batch
under `batches/N.json`, written aside and moved in place; only listed files are read. So a batch that Spark sends again, after a driver that died
between its commit and Spark's own note of it, finds its number taken: its files are removed and the first ones stay. An aborted batch's files
are removed too. The folder may be in any store that pyarrow.fs opens, and must be shared by the driver and the executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "marginalia_events"
#: Rows that a task holds at a time to put them in order; a batch's events of a task beyond that are ordered by the reader.
ROWS_AT_ONCE = 100_000


def _open(path: str):
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


@dataclass
class Told(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class EventWriter(DataSourceStreamWriter):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Told:
        files, root = _open(self.path)
        files.create_dir(f"{root}/parts", recursive=True)
        told, held = Told(), []

        def flush() -> None:
            if held:
                name = f"{uuid.uuid4().hex}.json"
                held.sort(key=lambda r: (r.get("session_id") or "", r.get("step") or 0))
                with files.open_output_stream(f"{root}/parts/{name}") as out:
                    out.write("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in held).encode())
                told.files.append(name)
                held.clear()

        for row in iterator:
            held.append(row.asDict(recursive=True))
            if len(held) >= ROWS_AT_ONCE:
                flush()
        flush()
        return told

    def commit(self, messages: list[Told | None], batchId: int) -> None:
        from pyarrow import fs

        files, root = _open(self.path)
        files.create_dir(f"{root}/batches", recursive=True)
        target = f"{root}/batches/{batchId}.json"
        if files.get_file_info(target).type != fs.FileType.NotFound:
            self.abort(messages, batchId)
            return
        aside = f"{root}/batches/.{uuid.uuid4().hex}"
        with files.open_output_stream(aside) as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())
        files.move(aside, target)

    def abort(self, messages: list[Told | None], batchId: int) -> None:
        files, root = _open(self.path)
        for m in messages:
            for name in m.files if m else ():
                files.delete_file(f"{root}/parts/{name}")


class EventSink(DataSource):
    """Options: path."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamWriter(self, schema: StructType, overwrite: bool) -> EventWriter:
        return EventWriter(self.options["path"])


def write_events(events: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Starts a query that writes a stream of events to path; each batch is there once, whole."""
    events.sparkSession.dataSource.register(EventSink)
    writer = events.writeStream.format(NAME).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def read_events(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The events of committed batches. The driver reads a list of files a batch."""
    from pyarrow import fs

    files, root = _open(path.rstrip("/"))
    listed = [x.path for x in files.get_file_info(fs.FileSelector(f"{root}/batches", allow_not_found=True)) if x.base_name.endswith(".json") and not x.base_name.startswith(".")]
    names = [n for p in sorted(listed) for n in json.loads(files.open_input_stream(p).read())]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path.rstrip('/')}/parts/{n}" for n in names])
