"""SRC9: rows published by a stream in transactions, as a data source.

Tasks write files that nobody lists; the commit of a micro-batch publishes their names in one
manifest, moved into place under the batch's number.  Readers open listed files only, so a
retried task, an aborted batch or a batch that is replayed leaves one copy of every row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

from .trees import _file_system


@dataclass
class _Files(WriterCommitMessage):
    names: list[str]
    rows: int


class _Writer(DataSourceStreamArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, top = _file_system(self.path)
        fs.create_dir(f"{top}/data", recursive=True)
        name, out, rows = f"{uuid.uuid4().hex}.parquet", None, 0
        for batch in iterator:
            if not len(batch):
                continue
            out = out or pq.ParquetWriter(f"{top}/data/{name}", batch.schema, filesystem=fs)
            out.write_batch(batch)
            rows += len(batch)
        if out is None:
            return _Files([], 0)
        out.close()
        return _Files([name], rows)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        fs, top = _file_system(self.path)
        fs.create_dir(f"{top}/manifest", recursive=True)
        final = f"{top}/manifest/{batchId:012d}.json"
        if fs.get_file_info(final).type != FileType.NotFound:      # published before: this is a replay
            self.abort(messages, batchId)
            return
        staged = f"{top}/manifest/.{uuid.uuid4().hex}"
        done = [m for m in messages if m is not None]
        with fs.open_output_stream(staged) as f:
            f.write(json.dumps({"files": [n for m in done for n in m.names], "rows": sum(m.rows for m in done)}).encode())
        fs.move(staged, final)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        fs, top = _file_system(self.path)
        for m in messages:
            for n in m.names if m is not None else []:
                if fs.get_file_info(f"{top}/data/{n}").type != FileType.NotFound:
                    fs.delete_file(f"{top}/data/{n}")


class PublishedRows(DataSource):
    """Streaming sink ``published_rows`` with the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "published_rows"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return _Writer(self.options["path"])


def publish_stream(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Publish a streaming DataFrame's available rows under ``path``."""
    rows.sparkSession.dataSource.register(PublishedRows)
    q = (rows.writeStream.format("published_rows").option("path", path).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    q.awaitTermination()


def published(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows published under ``path``.  The driver reads one manifest a batch: file names, no rows."""
    fs, top = _file_system(path)
    if fs.get_file_info(f"{top}/manifest").type == FileType.NotFound:
        return spark.createDataFrame([], schema)
    names: list[str] = []
    for info in fs.get_file_info(FileSelector(f"{top}/manifest")):
        if info.base_name.endswith(".json") and not info.base_name.startswith("."):
            with fs.open_input_stream(info.path) as f:
                names += json.loads(f.read())["files"]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path.rstrip('/')}/data/{n}" for n in names))
