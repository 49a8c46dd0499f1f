"""Digests of files of any size, and files written out of a table.

Files are opened with pyarrow's file systems (local and mounted paths, hdfs, s3, gs), in tasks, and read in pieces, so that a file needs no more memory than a piece and may be larger than 2 GB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE = 8 << 20
SCHEMA = "file_path string, size long, sha256 string, error string"


def opened(uri: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:", "", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def digest_of(system, path: str) -> tuple[str | None, str | None]:
    """(SHA-256, None), or (None, the error's text) where the file can't be read to its end."""
    state = hashlib.sha256()
    try:
        with system.open_input_stream(path, buffer_size=0) as stream:
            while piece := stream.read(PIECE):
                state.update(piece)
    except (OSError, pa.ArrowException) as error:
        return None, f"{type(error).__name__}: {error}"[:500]
    return state.hexdigest(), None


class FileRange(InputPartition):
    """Some files, in order of path."""

    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class DigestReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].rstrip("/")
        self.bytes, self.count = int(options.get("partitionBytes", 256 << 20)), int(options.get("partitionFiles", 10_000))

    def partitions(self) -> list[FileRange]:
        """Ranges of files with about ``partitionBytes`` bytes and at most ``partitionFiles`` files; a larger file is a range of its own."""
        from pyarrow import fs

        system, path = opened(self.root)
        found = sorted((f.path, f.size or 0) for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type != fs.FileType.Directory)
        ranges: list[list[tuple[str, int]]] = []
        load = 0
        for name, size in found:
            if not ranges or load + size > self.bytes or len(ranges[-1]) >= self.count:
                ranges.append([])
                load = 0
            ranges[-1].append((name, size))
            load += size
        return [FileRange(r) for r in ranges] or [FileRange([])]

    def read(self, partition: FileRange) -> Iterator[tuple]:
        system, top = opened(self.root)
        # as Spark spells paths: file:/folder/name
        spelled = self.root if ":/" in self.root else f"file:{top}"
        spelled = f"file:{top}" if spelled.startswith("file:") else spelled
        for name, size in partition.files:
            sha, error = digest_of(system, name)
            yield f"{spelled}{name[len(top):]}", size, sha, error


class FileDigests(DataSource):
    """``spark.read.format("file_digests").load(folder)``: (file_path, size, sha256, error) of every file below a folder; sha256 is null and error says why where a file can't be read."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DigestReader:
        return DigestReader(self.options)


def file_digests(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").options(**options).load(path)


def write_files(contents: DataFrame, root: str) -> DataFrame:
    """Write each (name, content) as a file below ``root``; (name, size) of what was written, when it is read. A task that is run again writes the same files again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(root)
        made: set[str] = set()
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                folder = f"{top}/{name}".rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{top}/{name}") as stream:
                    stream.write(content or b"")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sizes, pa.int64())], ["name", "size"])

    return contents.selectExpr("name", "cast(content as binary) as content").mapInArrow(write, "name string, size long")
