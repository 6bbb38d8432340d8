"""One file per row, at the row's own path.

Spark's writers name their files themselves, so documents that have to stand
at a given relative path are written by a data source of our own in two steps:

* each task writes its documents, numbered, into a staging folder of its
  attempt, with a manifest of their paths.  Only attempts whose task has
  committed are listed by the job's commit; a failed or speculative attempt,
  or a failed job, leaves nothing that anyone reads;
* a Spark job over the committed manifests then moves each file to its path.
  A move is atomic for each file, and a repeated one finds it done, so a lost
  executor costs nothing but the retry.

The driver sees one message per task and never the list of files.  Folders are
reached through Arrow's file systems (local and mounted folders, S3, HDFS).
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

# shipped by value: executors need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MANIFEST = "folder string, number long, path string"


def _opened(uri: str):
    """File system and path of a folder given as a URI or a plain path."""
    import pyarrow.fs
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pyarrow.fs.FileSystem.from_uri(uri)


@dataclass
class _Staged(WriterCommitMessage):
    folder: str
    files: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, staging: str):
        self.staging = staging

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Staged:
        import json
        import uuid as ids

        from pyspark import TaskContext
        fs, root = _opened(self.staging)
        folder = f"task-{TaskContext.get().partitionId():06d}-{ids.uuid4().hex[:12]}"
        number = 0
        try:
            fs.create_dir(f"{root}/{folder}")
            with fs.open_output_stream(f"{root}/{folder}/manifest.json") as manifest:
                for batch in iterator:
                    for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        if content is None:
                            continue
                        parts = (path or "").split("/")
                        if not path or path.startswith("/") or any(p in ("", ".", "..") for p in parts):
                            raise ValueError(f"not a path below the output folder: {path!r}")
                        with fs.open_output_stream(f"{root}/{folder}/{number}") as out:
                            out.write(content.encode())
                        manifest.write(json.dumps({"folder": folder, "number": number, "path": path}).encode() + b"\n")
                        number += 1
        except BaseException:
            fs.delete_dir(f"{root}/{folder}")
            raise
        return _Staged(folder, number)

    def commit(self, messages) -> None:
        fs, root = _opened(self.staging)
        fs.create_dir(root)
        with fs.open_output_stream(f"{root}/committed") as out:
            out.write("".join(f"{m.folder}\n" for m in messages if m is not None and m.files).encode())

    def abort(self, messages) -> None:
        import pyarrow.fs
        fs, root = _opened(self.staging)
        if fs.get_file_info(root).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(root)


class StagedFiles(DataSource):
    """Write-only: rows (path, content) as numbered files below the option
    ``staging``."""

    @classmethod
    def name(cls) -> str:
        return "tessera_staged_files"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["staging"])


def _mover(base: str, staging: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow
        import pyarrow.fs
        fs, target = _opened(base)
        _, source = _opened(staging)
        made = set()
        for batch in batches:
            size = []
            for folder, number, path in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = f"{source}/{folder}/{number}", f"{target}/{path}"
                parent = b.rsplit("/", 1)[0]
                if parent not in made:
                    fs.create_dir(parent)
                    made.add(parent)
                if fs.get_file_info(a).type != pyarrow.fs.FileType.NotFound:  # else an earlier attempt has moved it
                    fs.move(a, b)
                size.append(fs.get_file_info(b).size)
            yield pyarrow.RecordBatch.from_arrays([batch.column(2), pyarrow.array(size, pyarrow.int64())], names=["path", "bytes"])
    return run


def write_files(df: DataFrame, base: str, path: Column | str = "path", content: Column | str = "content") -> DataFrame:
    """Write each row's ``content`` (UTF-8) to ``base``/``path`` and return
    ``(path, bytes)`` of the files written, as a table kept beside them in
    ``base``/_files.

    A row whose content is null has no file.  A path must be relative and
    stay below ``base``; two rows with one path are an error, and then, as
    after any failed task, no file is written (tasks that are killed while the
    job fails may leave their staging folder, ``base``/_staging-*, which
    nothing reads).  A file that stood at a path is replaced.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex[:12]
    base = base.rstrip("/")
    staging = f"{base}/_staging-{run}"
    spark.dataSource.register(StagedFiles)
    as_column = [c if isinstance(c, Column) else F.col(c) for c in (path, content)]
    rows = df.select(as_column[0].cast("string").alias("path"), as_column[1].cast("string").alias("content"))
    rows.write.format(StagedFiles.name()).option("staging", staging).mode("append").save()
    fs, root = _opened(staging)
    try:
        folders = [r["value"] for r in spark.read.text(f"{staging}/committed").collect()]  # one per task
        listed = (spark.read.schema(_MANIFEST).json([f"{staging}/{f}/manifest.json" for f in folders]) if folders
                  else spark.createDataFrame([], _MANIFEST))
        twice = listed.groupBy("path").count().where("count > 1").limit(3).collect()
        if twice:
            raise ValueError(f"several documents for one path: {[r['path'] for r in twice]}")
        listed.mapInArrow(_mover(base, staging), "path string, bytes long").write.parquet(f"{base}/_files/{run}")
    finally:
        fs.delete_dir(root)
    return spark.read.schema("path string, bytes long").parquet(f"{base}/_files/{run}")


def read_files(spark: SparkSession, base: str) -> DataFrame:
    """``(path, content)`` of all documents below ``base``."""
    root = base.rstrip("/")
    text = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    # folders of our own start with an underscore, which Spark's readers leave out only at a path's end
    path = F.expr("substr(path, length(root) + 1)")
    at = text.select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"), F.col("value").alias("content"),
                     F.lit(root.replace("file:", "").rstrip("/") + "/").alias("root"))
    return at.select(path.alias("path"), "content").where("path NOT LIKE '\\\\_%'")


def write_redacted(redacted: DataFrame, base: str, path: Column | str, method: str = "replace", as_json: bool = False,
                   text_col: str = "text", redacted_col: str = "redacted", spans_col: str = "_isl") -> DataFrame:
    """S11 (directory form): each redacted document at its relative path, as
    its text or as a JSON record (path, lengths, count, method, text).  A
    document without entities has no file."""
    path = path if isinstance(path, Column) else F.col(path)
    record = F.to_json(F.struct(
        path.alias("file_path"), F.length(text_col).alias("original_text_length"),
        F.length(redacted_col).alias("anonymized_text_length"), F.size(spans_col).alias("entities_redacted"),
        F.lit(method).alias("anonymize_method"), F.col(redacted_col).alias("anonymized_text")))
    return write_files(redacted.where(F.size(spans_col) > 0), base, path, record if as_json else F.col(redacted_col))
