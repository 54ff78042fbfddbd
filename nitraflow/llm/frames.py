"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a word everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. A local session without
    one (a test) gets a temporary folder; on a cluster the setting is needed."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="nitraflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read again: later jobs read the
    table instead of computing df anew, also after executors are lost."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `written` whose readers have all been written themselves."""
    for df in tables:
        spark = df.sparkSession
        folders = {f.rpartition("/")[0] for f in df.inputFiles()}
        own = shared_folder(spark)
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName() and str(path.toUri().getPath()).startswith(spark._jvm.org.apache.hadoop.fs.Path(own).toUri().getPath()):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_struct(df: DataFrame, text: str, out: str, fields: T.StructType, fn: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """df with a struct column out = fn(text column), batch by batch through Arrow. A column of that
    name which df already has is replaced."""
    if text.lower() == out.lower():
        raise ValueError("the output can't replace the text that it is made from")
    base = df.drop(out)
    at = [c.lower() for c in base.columns].index(text.lower())

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, fn(b.column(at))], names=[*b.schema.names, out])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(out, fields)]))


def struct_array(n: int, columns: dict[str, object]) -> pa.Array:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    assert all(len(a) == n for a in arrays)
    return pa.StructArray.from_arrays(arrays, names=list(columns))


def hash_part(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    c = F.col(key) if isinstance(key, str) else key
    return F.crc32(c.cast("string").cast("binary")) % n


def free_name(df: DataFrame, name: str, *more: str) -> str:
    """name, or name with as many underscores as it takes to clash with no column of df."""
    taken = {c.lower() for c in (*df.columns, *more)}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: named only in a lambda's body, an expression would be
    computed anew for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)
