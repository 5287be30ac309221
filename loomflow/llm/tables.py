"""Tables and shared folders of the numbered queries."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def fold_of(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


def row_key(*columns: Column) -> Column:
    """128 bits that identify a row by some of its columns; null differs from any value."""
    each = [x for c in columns for x in (F.octet_length(c.cast("string")), c.cast("string"))]
    return F.unhex(F.md5(F.concat_ws("\0", *(F.coalesce(x.cast("string"), F.lit("")) for x in each))))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many marks behind it as keep it apart from the columns of `df`, in any case of letters."""
    taken, out = {x.lower() for x in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset and the master is local, as in tests, one of our own."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir names no folder that all machines share")
    if not found:
        found = tempfile.mkdtemp(prefix="loomflow-checkpoints-")  # one machine has all tasks
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a table written once in the shared folder, so that later jobs read it and lost executors don't undo it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
