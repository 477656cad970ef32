"""SRC1, SRC2: a source tree walked as a data source, and the listed files read.

``SourceTree`` is a Python data source.  The driver lists no more than the upper folders,
until there are enough of them to share out; each partition then walks the folders below
its own.  Files are opened where they lie by whatever file system the URI names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# What the modelled walk leaves out, and the files it takes.
SKIPPED = (".", "__")
SUFFIX = ".py"


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``uri`` and the path in it; a bare path is local."""
    return pafs.FileSystem.from_uri(uri) if ":" in uri.split("/", 1)[0] else (pafs.LocalFileSystem(), uri)


def _entries(fs: pafs.FileSystem, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
    """Names of the kept folders, and name and size of the kept files, directly in ``folder``."""
    found = [f for f in fs.get_file_info(pafs.FileSelector(folder)) if not f.base_name.startswith(SKIPPED)]
    return (sorted(f.base_name for f in found if f.type == pafs.FileType.Directory),
            sorted((f.base_name, f.size) for f in found if f.type == pafs.FileType.File))


class _Walk(DataSourceReader):
    def __init__(self, root: str, suffix: str, want: int) -> None:
        self.root, self.suffix, self.want = root.rstrip("/"), suffix, want

    def partitions(self) -> list[InputPartition]:
        """(folder, whether its sub-folders are its own): upper folders first list only their files."""
        fs, top = _file_system(self.root)
        if fs.get_file_info(top).type != pafs.FileType.Directory:
            raise FileNotFoundError(self.root)
        whole, shallow = [""], []
        while whole and len(whole) < self.want:
            below = [f"{d}/{x}".lstrip("/") for d in whole for x in _entries(fs, f"{top}/{d}".rstrip("/"))[0]]
            shallow += whole
            whole = below
        return [InputPartition((d, False)) for d in shallow] + [InputPartition((d, True)) for d in whole]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, top = _file_system(self.root)
        first, deep = partition.value
        todo = [first]
        while todo:
            folder = todo.pop()
            below, files = _entries(fs, f"{top}/{folder}".rstrip("/"))
            for name, size in files:
                if name.endswith(self.suffix):
                    yield self.root, folder, name, f"{self.root}/{folder}/{name}" if folder else f"{self.root}/{name}", size
            if deep:
                todo += [f"{folder}/{x}".lstrip("/") for x in below]


class SourceTree(DataSource):
    """Files under ``path`` whose name ends in ``suffix``: repo, dir, name, path, size.

    Folders and files that begin with a dot or two underscores are left out; one underscore
    is an ordinary name.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "repo string, dir string, name string, path string, size bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Walk(self.options["path"], self.options.get("suffix", SUFFIX), int(self.options.get("partitions", "32")))


def list_files(spark: SparkSession, root: str, suffix: str = SUFFIX) -> DataFrame:
    """(repo, dir, name, path, size) of every matching file; contents are not read."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("suffix", suffix).load(root)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the text of their file; a file that is gone or no UTF-8 has no row."""
    for batch in batches:
        for i, path in enumerate(batch.column("path").to_pylist()):
            fs, at = _file_system(path)
            try:
                with fs.open_input_stream(at) as f:
                    text = f.read().decode("utf-8")
            except (UnicodeDecodeError, FileNotFoundError):
                continue
            row = batch.slice(i, 1)
            # line ends as text-mode reading gives them
            text = pa.array([text.replace("\r\n", "\n").replace("\r", "\n")], pa.string())
            yield pa.RecordBatch.from_arrays([*row.columns, text], [*row.schema.names, "contents"])


def read_texts(files: DataFrame) -> DataFrame:
    """``files`` with their ``contents`` as text (SRC2); only the listed files are opened.

    Undecodable files are dropped; CR LF and lone CR become LF, as text-mode reading does.
    The files are dealt out by their path, so the listing's partitions do not matter.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + ", contents string"
    return files.repartition("path").mapInArrow(_contents, schema)


def candidate_files(spark: SparkSession, root: str, min_files: int, min_len: int) -> DataFrame:
    """Walk, keep directories with enough file names (counted before reading), read,
    keep files longer than ``min_len`` characters (SRC1, FLT5, SRC2, FLT6)."""
    from ..operators.corpus import dir_threshold, length_filter
    from ..session import written
    listed = written(list_files(spark, root), "files")           # counted and filtered: walked once
    return length_filter(read_texts(dir_threshold(listed, "dir", min_files)), "contents", min_len)


def write_files(rows: DataFrame, root: str, path: str, contents: str) -> int:
    """Write one file per row: ``contents`` (binary) at ``path`` under ``root``; returns how many.

    A repeated task writes the same files again.
    """
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for to, data in zip(batch.column(path).to_pylist(), batch.column(contents).to_pylist(), strict=True):
                fs, at = _file_system(f"{root.rstrip('/')}/{to}")
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(at) as f:
                    f.write(data or b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    done = rows.select(F.col(path), F.col(contents).cast("binary").alias(contents)).mapInArrow(put, "n bigint")
    return done.agg(F.sum("n")).first()[0] or 0
