"""XES event logs by Spark's XML source: one row for each trace, attributes as arrays by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = ("string", "date", "int", "float", "boolean", "id")
_ATTR = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())]))
_EVENT = T.StructType([T.StructField(t, _ATTR) for t in TAGS])
SCHEMA = T.StructType([T.StructField(t, _ATTR) for t in TAGS] + [T.StructField("event", T.ArrayType(_EVENT))])


def read_traces(spark: SparkSession, path: str, strict: bool = False, partitions: int | None = None) -> DataFrame:
    """Traces of XES files, plain or gzip. A gzip file is one task, so `partitions` deals its traces out afterwards.

    A malformed trace fails the read if `strict`, else it is a row of nulls.
    """
    out = spark.read.format("xml").option("rowTag", "trace").option("ignoreNamespace", "true").option("mode", "FAILFAST" if strict else "PERMISSIVE").schema(SCHEMA).load(path)
    return out.repartition(partitions) if partitions else out


def last_value(attributes: Column, key: str) -> Column:
    """The value of the last attribute of a key, as a dictionary would keep it; null if there is none."""
    return F.try_element_at(F.filter(attributes, lambda a: a["_key"] == key), F.lit(-1))["_value"]


def attribute(row: str, key: str, tags: tuple[str, ...] = TAGS) -> Column:
    """A key's value under any of the types, in their order."""
    return F.coalesce(*[last_value(F.col(f"{row}.{t}") if row else F.col(t), key) for t in tags])


def raw_events(traces: DataFrame, activity: str = "concept:name", time: str = "time:timestamp", lifecycle: str = "lifecycle:transition", resource: str = "org:resource") -> DataFrame:
    """(case_id, ord, activity, ts, lifecycle, resource) of every event, in document order; a bad date is null."""
    own = traces.select(attribute("", "concept:name").alias("case_id"), F.posexplode("event").alias("ord", "e"))
    stamp = F.try_to_timestamp(last_value(F.col("e.date"), time))
    return own.select("case_id", F.col("ord").cast("long").alias("ord"), attribute("e", activity).alias("activity"), F.to_timestamp_ntz(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("ts"), attribute("e", lifecycle).alias("lifecycle"), attribute("e", resource).alias("resource"))


def rejected(events: DataFrame, by_lifecycle: bool) -> DataFrame:
    """Events with why each is left out: lifecycle, then timestamp, then activity; null if it is kept."""
    off = ~(F.lower(F.trim(F.coalesce("lifecycle", F.lit("")))) == "complete") if by_lifecycle else F.lit(False)
    return events.withColumn("reason", F.when(off, "lifecycle").when(F.col("ts").isNull(), "timestamp").when(F.coalesce("activity", F.lit("")) == "", "activity"))


def parse_counts(events: DataFrame) -> DataFrame:
    """Counts of a parse in one pass over rejected(): raw cases and events, reasons, kept events, and the observed span."""
    kept = F.col("reason").isNull()
    return events.agg(
        F.countDistinct("case_id").alias("raw_cases"), F.count("*").alias("raw_events"), *[F.count_if(F.col("reason") == x).alias(f"bad_{x}") for x in ("lifecycle", "timestamp", "activity")],
        F.count_if(kept).alias("kept_events"), F.countDistinct(F.when(kept, F.col("activity"))).alias("activities"), F.min(F.when(kept, F.col("ts"))).alias("first"), F.max(F.when(kept, F.col("ts"))).alias("last"),
    )


def log(events: DataFrame) -> DataFrame:
    """The event log of kept events."""
    return events.where("reason is null").select("case_id", "ts", "ord", "activity")


def profile(traces: DataFrame, samples: int = 5) -> DataFrame:
    """(scope, key, tag, n, samples): keys of trace and event attributes, how often each type has them, and a few values in order."""

    def flat(scope: str, df: DataFrame, row: str) -> DataFrame:
        def tagged(t: str) -> Column:
            return F.transform(F.coalesce(F.col(f"{row}{t}"), F.array()), lambda a: F.struct(F.lit(t).alias("tag"), a["_key"].alias("key"), a["_value"].alias("value")))

        parts = [tagged(t) for t in TAGS]
        return df.select(F.lit(scope).alias("scope"), F.explode(F.concat(*parts)).alias("x")).select("scope", "x.*")

    every = flat("trace", traces, "").union(flat("event", traces.select(F.explode("event").alias("e")), "e."))
    counts = every.groupBy("scope", "key", "tag").agg(F.count("*").alias("n"))
    # The first values of each key: distinct values are ranked, never collected whole.
    values = every.select("scope", "key", "tag", F.substring("value", 1, 200).alias("value")).distinct()
    first = values.withColumn("k", F.row_number().over(Window.partitionBy("scope", "key", "tag").orderBy("value"))).where(F.col("k") <= samples)
    return counts.join(first.groupBy("scope", "key", "tag").agg(F.array_sort(F.collect_list("value")).alias("samples")), ["scope", "key", "tag"])
