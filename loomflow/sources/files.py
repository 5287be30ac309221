"""Parquet, CSV and JSON in and out; results keyed by configuration; provenance."""

from __future__ import annotations

import hashlib
import json
import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from loomflow.config import Config


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """A Parquet table; the filter and the columns reach the scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


class Catalog:
    """Tables by name; a name that is not listed is refused, so that no later window is read by mistake."""

    def __init__(self, spark: SparkSession, folder: str, allowed: dict[str, StructType | str]):
        self.spark, self.folder, self.allowed = spark, folder, allowed

    def csv(self, name: str) -> DataFrame:
        if name not in self.allowed:
            raise PermissionError(f"{name} may not be read here")
        return read_csv(self.spark, f"{self.folder}/{name}.csv", self.allowed[name])


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    out = df.write.mode("overwrite").option("compression", "zstd")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header, nulls empty; for result tables of a few thousand rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_csv_with_mark(df: DataFrame, path: str) -> None:
    """As write_csv(), the text in UTF-8 behind a byte order mark, which some spreadsheets need."""
    first, *rest = df.columns
    write_csv(df.withColumnRenamed(first, "\ufeff" + first), path)


def write_counts(df: DataFrame, key: str, path: str, most: int | None = None) -> None:
    """A key's counts, most frequent first, ties by key."""
    counted = df.groupBy(key).agg(F.count("*").alias("count")).orderBy(F.desc("count"), key)
    write_csv(counted.limit(most) if most else counted, path)


def safe(value):
    """As JSON allows: no NaN or infinity."""
    if isinstance(value, dict):
        return {str(k): safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [safe(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_json(value: dict, path: str) -> None:
    Path(path).write_text(json.dumps(safe(value), indent=2, sort_keys=True, allow_nan=False, default=str), encoding="utf-8")


def detail(df: DataFrame, most: int = 100_000) -> tuple[DataFrame, bool]:
    """At most so many detail rows for a report, and whether there were more."""
    return df.limit(most), df.limit(most + 1).count() > most


def stored(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at `path`, made and written there if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        write_table(make(), path)
        return spark.read.parquet(path)


def cached(spark: SparkSession, folder: str, name: str, cfg: Config, make) -> DataFrame:
    """A table stored under its configuration's hash; other parameters never reuse it."""
    return stored(spark, f"{folder}/{name}-{cfg.digest()[:16]}", make)


def filtered_only(df: DataFrame) -> DataFrame:
    """`df`, refused if a file scan in its plan has no filter that reached it: what lies outside a window is then never read as a fallback."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan .*", plan)
    if not scans or any("PushedFilters: []" in x and "PartitionFilters: []" in x for x in scans):
        raise PermissionError("a scan without a pushed filter is refused here")
    return df


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON documents, one or more lines each; a malformed one fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def checksum(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, by the binary source."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def code_digest() -> str:
    """A hash of this package's source files: their names and texts, in order."""
    root = Path(__file__).resolve().parent.parent
    own = hashlib.sha256()
    for f in sorted(root.rglob("*.py")):
        own.update(f"{f.relative_to(root)}\0".encode() + f.read_bytes() + b"\0")
    return own.hexdigest()


def provenance(spark: SparkSession, cfg: Config, outputs: dict[str, DataFrame], portfolios: DataFrame | None = None) -> dict:
    """Versions, parameters, hashes of code and frozen portfolios, and an order-free hash of each result."""
    def digest(df: DataFrame) -> str:
        row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x")).first()
        return hashlib.sha256(f"{row['n']}:{row['x']}".encode()).hexdigest()

    out = {"spark": spark.version, "config": cfg.digest(), "code": code_digest(), "outputs": {k: digest(v) for k, v in outputs.items()}}
    if portfolios is not None:
        line = F.concat_ws("|", "method", F.concat(F.lit("K="), "K"), "rank", "transition")
        out["portfolios"] = portfolios.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("x")).first()["x"]  # methods x sizes x K lines
    return out
