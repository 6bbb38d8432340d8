"""Directory scan by rounds of Spark jobs.

The frontier of directories is a table.  Each round lists every directory of
it, many at once, writes what it found and takes the directories among it as
the next frontier.  Neither the paths nor the directories pass through the
driver, and a round that is lost is listed again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import DEFAULT_SUPPORTED_EXTENSIONS, file_type, is_supported
from ..session import scratch_path

_FOUND = "file_path string, is_dir boolean, file_size long, modified_time timestamp"
#: directories listed by one task
A_TASK = 256


def _lister(root_uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import pyarrow
        import pyarrow.fs
        uri = "file://" + root_uri[len("file:"):] if root_uri.startswith("file:/") and not root_uri.startswith("file://") else root_uri
        fs, _ = pyarrow.fs.FileSystem.from_uri(uri)
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        kinds = [pyarrow.string(), pyarrow.bool_(), pyarrow.int64(), pyarrow.timestamp("us", "UTC")]
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                # a folder that is gone meanwhile has nothing
                found = fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
                rows = []
                for f in found:
                    folder_kind = f.type == pyarrow.fs.FileType.Directory
                    if folder_kind and local and os.path.islink(f.path):
                        continue  # links to folders are not followed: they may lead in circles
                    rows.append((f.path, folder_kind, None if folder_kind else f.size, f.mtime))
                yield pyarrow.RecordBatch.from_arrays(
                    [pyarrow.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)],
                    names=["file_path", "is_dir", "file_size", "modified_time"])
    return run


def walk(spark: SparkSession, directory: str, extensions=DEFAULT_SUPPORTED_EXTENSIONS, recursive: bool = True) -> DataFrame:
    """``(file_path, file_size, modified_time, file_type)`` of all files
    below a directory, of the given extensions (None: all).

    The directory is a path or a URI of a file system that Arrow opens.  One
    that does not exist is empty.  A single directory is listed by one task.
    """
    import pyarrow.fs
    uri = "file://" + directory[len("file:"):] if directory.startswith("file:/") and not directory.startswith("file://") else directory
    _, root = pyarrow.fs.FileSystem.from_uri(uri)
    store = scratch_path(spark, f"tessera-walk-{uuid.uuid4().hex[:12]}")
    frontier, folders, rounds = spark.createDataFrame([(root.rstrip("/") or "/",)], "file_path string"), 1, 0
    while folders:
        tasks = max(1, min(-(-folders // 8), max(spark.sparkContext.defaultParallelism, -(-folders // A_TASK))))
        frontier.repartition(tasks, "file_path").mapInArrow(_lister(directory), _FOUND).write.parquet(f"{store}/round={rounds}")
        found = spark.read.schema(_FOUND).parquet(f"{store}/round={rounds}")
        frontier, rounds = found.where("is_dir").select("file_path"), rounds + 1
        folders = frontier.count() if recursive else 0
    files = spark.read.schema(_FOUND).parquet(*(f"{store}/round={r}" for r in range(rounds))).where("NOT is_dir").select(
        "file_path", "file_size", "modified_time", file_type(F.col("file_path")).alias("file_type"))
    return files if extensions is None else files.where(is_supported(F.col("file_path"), extensions))
