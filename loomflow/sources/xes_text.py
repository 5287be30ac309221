"""A second reading of XES logs, by text records instead of the XML source: for comparison, and for logs with broken parts.

A plain file is split by the end tag of traces, so that many tasks read it. A record
that is no well-formed trace is cut into its events, and those that are well-formed stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomflow.sources import xes

_CORRUPT = "_corrupt"
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "ignoreNamespace": "true"}
_TRACE = T.StructType([*xes.SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])
_EVENT = T.StructType([*xes.SCHEMA["event"].dataType.elementType.fields, T.StructField(_CORRUPT, T.StringType())])


def _from(text: Column, tag: str) -> Column:
    """What follows from the last opening of a tag on; null without one."""
    return F.nullif(F.regexp_extract(text, rf"(?s)^.*(<{tag}[\s/>].*)$", 1), F.lit(""))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(trace): the text of each trace, from its start tag to its end tag."""
    raw = spark.read.text(path, lineSep="</trace>")
    return raw.select(F.concat(F.nullif(F.regexp_extract("value", r"(?s)(<trace[\s>].*)$", 1), F.lit("")), F.lit("</trace>")).alias("trace")).where("trace is not null")


def second_parse(spark: SparkSession, path: str) -> DataFrame:
    """Traces of xes.SCHEMA, read as text and parsed one by one; a malformed trace is a row of nulls."""
    parsed = records(spark, path).select(F.from_xml("trace", _TRACE, _OPTIONS).alias("t"))
    good = F.col(f"t.{_CORRUPT}").isNull()
    return parsed.select(*[F.when(good, F.col(f"t.{c}")).alias(c) for c in xes.SCHEMA.names])


def recovered(spark: SparkSession, path: str, activity: str = "concept:name", time: str = "time:timestamp", lifecycle: str = "lifecycle:transition", resource: str = "org:resource") -> DataFrame:
    """Events as xes.raw_events() has them, with `recovered` and `malformed`: of malformed traces too.

    Those are cut at the end tags of events; a piece that is no well-formed event is a row
    with `malformed` and no values but the case. Their case is what the text before the
    first event names.
    """
    own = records(spark, path).select("trace", F.from_xml("trace", _TRACE, _OPTIONS).alias("t"))
    broken = F.col(f"t.{_CORRUPT}").isNotNull()
    whole = xes.raw_events(own.where(~broken).select("t.*"), activity, time, lifecycle, resource).withColumns({"recovered": F.lit(False), "malformed": F.lit(False)})
    head = F.regexp_extract("trace", r"(?s)^(.*?)(?:<event[\s/>]|</trace>)", 1)
    case = F.nullif(F.regexp_extract(head, r"""<string\s[^>]*key=["']concept:name["'][^>]*value=["']([^"']*)["']""", 1), F.lit(""))
    pieces = own.where(broken).select(case.alias("case_id"), F.posexplode(F.split("trace", "</event>")).alias("ord", "piece"))
    pieces = pieces.withColumn("piece", _from(F.col("piece"), "event")).where("piece is not null")
    parsed = pieces.select("case_id", "ord", F.from_xml(F.concat("piece", F.lit("</event>")), _EVENT, _OPTIONS).alias("e"))
    bad = F.col("e").isNull() | F.col(f"e.{_CORRUPT}").isNotNull()
    stamp = F.try_to_timestamp(xes.last_value(F.col("e.date"), time))
    values = {"activity": xes.attribute("e", activity), "ts": F.to_timestamp_ntz(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSSSSS")), "lifecycle": xes.attribute("e", lifecycle), "resource": xes.attribute("e", resource)}
    saved = parsed.select("case_id", F.col("ord").cast("long").alias("ord"), *[F.when(~bad, v).alias(k) for k, v in values.items()], F.lit(True).alias("recovered"), bad.alias("malformed"))
    return whole.unionByName(saved)


def parses_compared(first: DataFrame, second: DataFrame) -> DataFrame:
    """(measure, first, second, equal) of two one-row tables of counts."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("string").alias(name)) for c in df.columns])).alias("x")).select("x.*")

    out = long(first, "first").join(long(second, "second"), "measure", "full_outer")
    return out.select("measure", "first", "second", F.col("first").eqNullSafe(F.col("second")).alias("equal"))


def same_parses(first: DataFrame, second: DataFrame) -> None:
    """Fails where two parses differ, and says in what."""
    wrong = parses_compared(first, second).where("not equal").collect()
    if wrong:
        raise ValueError("parses differ: " + ", ".join(f"{r['measure']} {r['first']} and {r['second']}" for r in sorted(wrong)))
