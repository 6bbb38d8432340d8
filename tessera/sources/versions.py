"""Tables written by several versions of the ledger's schema, read as one.

Every version writes under its own ``schema_version`` folder.  A reader names
the columns of today and, for those that came later, the version that brought
them and what older rows have instead; no file is rewritten and no footer is
read to find a common schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_version(df: DataFrame, path: str, version: int, mode: str = "append") -> None:
    """Rows of a table as of a schema version."""
    df.write.mode(mode).parquet(f"{path.rstrip('/')}/schema_version={version}")


def read_versions(spark: SparkSession, path: str, schema: str | T.StructType, added: dict[str, tuple[int, object]] | None = None,
                  newest: int | None = None) -> DataFrame:
    """All rows under today's ``schema`` with the ``schema_version`` that
    wrote each.

    ``added`` maps a column to (the version that brought it, the value of
    older rows).  A column that a row's version had keeps its value, null
    included; one that it lacked is null, or the given value.  Rows of a
    version above ``newest`` are an error: their meaning is not known here.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*schema.fields, T.StructField("schema_version", T.IntegerType())])
    rows = spark.read.schema(whole).parquet(path)
    version = F.col("schema_version")
    for name, (since, old) in (added or {}).items():
        rows = rows.withColumn(name, F.when(version < since, F.lit(old)).otherwise(F.col(name)).cast(schema[name].dataType))
    if newest is not None:
        unknown = F.raise_error(F.concat(F.lit("schema version "), version.cast("string"), F.lit(f" is newer than {newest}")))
        rows = rows.withColumn("schema_version", F.when(version > newest, unknown.cast("int")).otherwise(version))
    return rows
