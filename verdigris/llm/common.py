"""What the operators share: tables in the shared folder, names that can't clash, ordered rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prefix of the columns that operators add for their own use.
OWN = "__vd_"


def own(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names for internal use that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        x = f"{OWN}{name}"
        while x.lower() in taken:
            x += "_"
        taken.add(x.lower())
        out.append(x)
    return tuple(out)


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that all executors share, which spark.checkpoint.dir names.

    Where that is unset a folder of this machine serves a local master only: on
    a cluster each executor would write to its own disk, so there it is an error.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if where is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="verdigris-")
        context.setCheckpointDir(where)
    return f"{where.rstrip('/')}/verdigris-{context.applicationId}"


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class TableLost(RuntimeError):
    """A table that was written can't be seen from here."""


def table(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage, and outlives executors. A table without files is an error, not an empty table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, _ = _files(spark, path)
    if not fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")):
        raise TableLost(f"no files in {path}; do all executors share that folder?")
    out = spark.read.schema(df.schema).parquet(path)
    out._verdigris_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that table() gave, once nothing that is still to run reads them."""
    for t in tables:
        fs, at = _files(t.sparkSession, t._verdigris_path)
        fs.delete(at, True)


def cleanup(spark: SparkSession) -> None:
    """Deletes all tables of this application. Results that haven't been read yet are lost with them."""
    fs, at = _files(spark, shared_dir(spark))
    fs.delete(at, True)


def quoted(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def as_ordered(field: T.StructField) -> Column:
    """The column, or its JSON where its type has no order."""
    c = quoted(field.name)
    return c if _orderable(field.dataType) else F.to_json(F.struct(c))


def row_order(df: DataFrame, *first: str) -> Column:
    """A struct that orders rows by the columns named, nulls last, then by all others: only equal rows tie."""
    rest = [f for f in df.schema.fields if f.name not in first]
    parts = [x for c in first for x in (quoted(c).isNull(), quoted(c))] + [as_ordered(f) for f in rest]
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """128 bits of hash of a whole row, as two numbers: equal for equal rows."""
    parts = [as_ordered(f) for f in df.schema.fields]
    marked = [p.isNull() for p in parts]
    return F.xxhash64(F.lit(11), *parts, *marked), F.xxhash64(F.lit(7919), *marked, *parts)


def text_of(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(quoted(text).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
