"""The ledger as a log of versions (L1-L4, L11): a bucketed base, deltas,
compaction, and claims by several workers.

A version is a small file that names one base and the deltas on top of it.  It
is created, never changed, and only if no file of its number exists, so of two
writers that build on the same version one commits and the other learns that
it has to look again.  Readers see whole versions.

* The **base** holds one row per key, bucketed and sorted by the key.  It is
  large and is never shuffled: deltas come to it.
* A **delta** holds new images of the rows that a batch has changed.
* The **state** is the base without the keys that a delta has, and the newest
  image of each of those.
* **Compaction** rewrites the base bucket by bucket, again without a shuffle
  of the base, and changes no row.
* A **claim** turns pending rows, and rows whose lease has run out, into
  'processing' under a worker's name until a deadline.  An outcome counts only
  while its worker still holds the lease.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: deltas from which on a compaction is due
MANY_DELTAS = 8


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


def _quoted(path: str) -> str:
    return path.replace("\\", "\\\\").replace("'", "\\'")


class LedgerStore:
    """One table of the ledger under ``folder``, keyed by ``key``."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "file_id"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        path = self._path("versions")
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    # ------------------------------------------------------------ versions
    def latest(self) -> tuple[int, dict | None]:
        """Number and content of the newest version."""
        root = self._path("versions")
        if not self._fs.exists(root):
            return 0, None
        number = max((int(s.getPath().getName()) for s in self._fs.listStatus(root) if s.getPath().getName().isdigit()), default=0)
        return number, self._read(number) if number else None

    def _read(self, number: int) -> dict:
        text = self.spark.read.text(str(self._path("versions", f"{number:010d}")), wholetext=True).first()
        return json.loads(text["value"])

    def _commit(self, number: int, content: dict) -> None:
        """Create version ``number``, or raise if there is one.  The content is
        written aside and renamed: no rename replaces a file that exists."""
        jvm = self.spark._jvm
        aside = self._path("versions", f".new-{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(aside), context.makeQualified(self._path("versions", f"{number:010d}")), no_options)
        except Exception as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"version {number} exists") from None
            raise

    # -------------------------------------------------------------- tables
    def create(self, rows: DataFrame, buckets: int) -> None:
        """The first version: a base of ``rows`` in so many buckets (one row
        per key)."""
        name = self._write_base(rows.repartition(buckets, self.key), buckets)
        self._commit(1, {"base": name, "buckets": buckets, "schema": rows.schema.jsonValue(), "deltas": []})

    def _write_base(self, rows: DataFrame, buckets: int, name: str | None = None) -> str:
        new = name is None
        name = name or f"base-{uuid.uuid4().hex[:12]}"
        writer = rows.write.bucketBy(buckets, self.key).sortBy(self.key).option("path", f"{self.folder}/{name}")
        writer.mode("errorifexists" if new else "append").saveAsTable(self._table(name))
        return name

    def _table(self, name: str) -> str:
        return f"tessera_{name.replace('-', '_')}"

    def _base(self, version: dict) -> DataFrame:
        """The base with its buckets; the session may not know it yet."""
        table = self._table(version["base"])
        if not self.spark.catalog.tableExists(table):
            schema = T.StructType.fromJson(version["schema"])
            ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(f"CREATE TABLE {table} ({ddl}) USING parquet CLUSTERED BY ({self.key}) SORTED BY ({self.key}) "
                           f"INTO {version['buckets']} BUCKETS LOCATION '{_quoted(self.folder)}/{version['base']}'")
        return self.spark.table(table)

    def _newest(self, version: dict) -> DataFrame:
        """The newest image of each key that a delta holds."""
        schema = T.StructType.fromJson(version["schema"])
        place = T.StructField("_place", T.IntegerType())
        if not version["deltas"]:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(T.StructType([*schema.fields, place])).parquet(
            *(f"{self.folder}/{d}" for d in version["deltas"]))
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*schema.fieldNames()), "_place").alias("r"))
        return newest.select("r.*")

    def state(self, number: int | None = None) -> DataFrame:
        """All rows as of a version (the newest by default)."""
        version = self._read(number) if number else self.latest()[1]
        if not version["deltas"]:
            return self._base(version)
        newest = self._newest(version)
        return self._base(version).join(newest.select(self.key), self.key, "left_anti").unionByName(newest)

    def append(self, rows: DataFrame, onto: int | None = None) -> int:
        """Commit a delta: new images of changed or new rows, one per key.
        ``onto`` is the version that they were derived from; if another one
        has been committed since, nothing is changed and :class:`Conflict`
        is raised.  Returns the new version's number."""
        number, version = self.latest()
        onto = number if onto is None else onto
        version = version if onto == number else self._read(onto)
        name = f"delta-{uuid.uuid4().hex[:12]}"
        fields = T.StructType.fromJson(version["schema"]).fieldNames()
        rows.select(*fields, F.lit(len(version["deltas"])).alias("_place")).write.parquet(f"{self.folder}/{name}")
        try:
            self._commit(onto + 1, {**version, "deltas": [*version["deltas"], name]})
        except Conflict:
            self._fs.delete(self._path(name), True)
            raise
        return onto + 1

    def due(self) -> bool:
        return len(self.latest()[1]["deltas"]) >= MANY_DELTAS

    def compact(self) -> int:
        """Fold the deltas into a new base; the state does not change."""
        number, version = self.latest()
        newest, base = self._newest(version), self._base(version)
        fields = T.StructType.fromJson(version["schema"]).fieldNames()
        image = newest.select(F.col(self.key).alias("_k"), F.struct(*fields).alias("_r"))
        # a left join keeps the base's buckets, so each task writes one of them
        kept = base.join(image, F.col(self.key) == F.col("_k"), "left").select(
            *(F.when(F.col("_k").isNotNull(), F.col(f"_r.{f}")).otherwise(F.col(f)).alias(f) for f in fields))
        name = self._write_base(kept, version["buckets"])
        added = newest.join(base.select(self.key), self.key, "left_anti").select(*fields)
        self._write_base(added.repartition(version["buckets"], self.key), version["buckets"], name)
        try:
            self._commit(number + 1, {**version, "base": name, "deltas": []})
        except Conflict:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
            self._fs.delete(self._path(name), True)
            raise
        return number + 1

    # -------------------------------------------------------------- claims
    def claim(self, worker: str, n: int, now: Column, lease: str, tries: int = 20) -> DataFrame:
        """L1: the next ``n`` rows (by key) that are pending, or whose lease
        has run out, go to ``worker`` until ``now`` + ``lease`` (an interval).
        Returns the claimed rows.  Several workers may claim at once: a
        version has one writer, and a claimer that loses looks again, so no
        row is given to two."""
        free = (F.col("status") == "pending") | ((F.col("status") == "processing") & (F.col("lease_until") < now))
        for _ in range(tries):
            number, _ = self.latest()
            rows = self.state(number).where(free).orderBy(self.key).limit(n)
            rows = rows.withColumns({"status": F.lit("processing"), "process_start": now, "worker": F.lit(worker),
                                     "lease_until": now + F.expr(f"INTERVAL {lease}"), "error_message": F.lit(None).cast("string")})
            try:
                return self.delta(self.append(rows, number))
            except Conflict:
                continue
        raise Conflict(f"{tries} attempts of {worker} to claim rows were overtaken")

    def delta(self, number: int) -> DataFrame:
        """The rows that a version's last delta has written."""
        version = self._read(number)
        return self.spark.read.schema(T.StructType.fromJson(version["schema"])).parquet(f"{self.folder}/{version['deltas'][-1]}")

    def finish(self, worker: str, outcomes: DataFrame, now: Column, tries: int = 20) -> DataFrame:
        """L2/L3: ``outcomes(key, ok, error_message)`` of a worker.  Rows whose
        lease it no longer holds keep their state; they are returned with the
        reason, the others become completed or error."""
        held = (F.col("status") == "processing") & (F.col("worker") == worker) & (F.col("lease_until") >= now)
        o = outcomes.select(self.key, F.col("ok").alias("_ok"), F.col("error_message").alias("_msg"))
        for _ in range(tries):
            number, version = self.latest()
            fields = T.StructType.fromJson(version["schema"]).fieldNames()
            rows = self.state(number).join(o, self.key).withColumn("_held", F.coalesce(held, F.lit(False)))
            done = rows.where("_held").withColumns({
                "status": F.when(F.col("_ok"), "completed").otherwise("error"), "process_end": now,
                "error_message": F.when(~F.col("_ok"), F.col("_msg"))}).select(*fields)
            try:
                self.append(done, number)
            except Conflict:
                continue
            return rows.where("NOT _held").select(self.key, F.when(F.col("worker") != worker, F.lit("claimed by another worker")).when(
                F.col("status") != "processing", F.lit("not in process")).otherwise(F.lit("lease has run out")).alias("reason"))
        raise Conflict(f"{tries} attempts of {worker} to report outcomes were overtaken")


def leased(files: DataFrame) -> DataFrame:
    """A files table with the columns of a lease."""
    return files.withColumn("worker", F.lit(None).cast("string")).withColumn("lease_until", F.lit(None).cast("timestamp_ntz"))
