"""Digests of large inputs by ranges, and results stored under them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomflow.config import Config
from loomflow.sources.files import stored

#: Bytes of a range, one task's work at a time, and of what is read at once.
RANGE, READ = 64 << 20, 1 << 20
#: Written with each stored result; raise it when a parser changes what it returns.
VERSION = 1


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, length, at, sha256): a digest of each range of each file. The listing reads no content, no file is ever one value, and empty files count for nothing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    each = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("at"))

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            found = []
            for r in frame.itertuples():
                store, name = fs.FileSystem.from_uri(r.path if "://" in r.path else r.path.replace("file:", "file://", 1))
                own, left = hashlib.sha256(), min(size, r.length - r.at)
                with store.open_input_file(name) as f:
                    f.seek(r.at)
                    while left > 0:
                        data = f.read(min(READ, left))
                        if not data:
                            raise OSError(f"{r.path} became shorter")
                        own.update(data)
                        left -= len(data)
                found.append(own.hexdigest())
            yield frame.assign(sha256=found)

    slots = spark.sparkContext.defaultParallelism
    return each.repartition(slots, "path", "at").mapInPandas(digest, "path string, length long, at long, sha256 string")


def tree(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, length, sha256) of each file: the digest of its length and its ranges' digests in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "sha256"))), lambda x: x["sha256"])  # 64 bytes for each range
    return ranges(spark, path, size).groupBy("path").agg(F.first("length").alias("length"), F.sha2(F.concat(F.first("length").cast("string"), F.lit(":"), F.array_join(parts, ",")), 256).alias("sha256"))


def signature(spark: SparkSession, path: str, size: int = RANGE) -> str:
    """One digest of all files under a path, whatever their names: their lengths and contents, in order of digest."""
    got = tree(spark, path, size).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "length", "sha256"))), "\n"), 256).alias("x"))
    return got.first()["x"]


def signed(spark: SparkSession, folder: str, name: str, cfg: Config, inputs: str, make: Callable[[], DataFrame], version: int = VERSION) -> DataFrame:
    """A table stored under its parameters, the inputs' signature and the parser's version; a changed byte anywhere makes it anew."""
    key = hashlib.sha256(f"{version}:{cfg.digest()}:{signature(spark, inputs)}".encode()).hexdigest()
    return stored(spark, f"{folder}/{name}-{key[:32]}", make)
