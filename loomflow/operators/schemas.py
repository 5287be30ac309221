"""The schema that JSON texts have in fact: types by key, joined over all rows, and a few samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Types as bits; a set of them is joined to one type. Not a number and a text, say, is a string.
BITS = {"null": 1, "boolean": 2, "int": 4, "double": 8, "string": 16, "array": 32, "object": 64}


def type_bit(schema: Column) -> Column:
    """The bit of a variant's schema."""
    kind = F.regexp_extract(schema, "^[A-Z]+", 0)
    by = {"VOID": "null", "BOOLEAN": "boolean", "BIGINT": "int", "DECIMAL": "double", "DOUBLE": "double", "FLOAT": "double", "STRING": "string", "ARRAY": "array", "OBJECT": "object"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in by.items() for x in (k, BITS[v])]), kind), F.lit(BITS["string"]))


def joined(bits: Column) -> Column:
    """The least type that holds all of a set: null in any, int in double, anything else in string."""
    own = bits.bitwiseAND(~BITS["null"])
    out = F.when(own == 0, "null")
    for name, bit in BITS.items():
        if bit > 1:
            out = out.when(own == bit, name)
    return out.when(own == BITS["int"] + BITS["double"], "double").otherwise("string")


def profile(df: DataFrame, column: str, scope: str, samples: int = 5, longest: int = 200) -> DataFrame:
    """(scope, key, tag, n, nulls, kinds, samples) of the keys of JSON objects in a column; texts that are none count for nothing.

    Types are joined by an aggregate, so that each task sends a few bits for each key. Samples
    are the first distinct values, each cut to `longest` characters.
    """
    own = df.select(F.try_parse_json(column).alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    each = own.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).select("key", F.col("value").cast("string").alias("text"), type_bit(F.schema_of_variant("value")).alias("bit"))
    null = F.col("bit") == BITS["null"]
    counts = each.groupBy("key").agg(F.count("*").alias("n"), F.count_if(null).alias("nulls"), F.bit_or("bit").alias("bits"))
    values = each.where(~null).select("key", F.substring("text", 1, longest).alias("text")).distinct()
    first = values.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("text"))).where(F.col("k") <= samples)
    some = first.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("text")), " | ").alias("samples"))
    return counts.join(some, "key", "left").select(F.lit(scope).alias("scope"), "key", joined(F.col("bits")).alias("tag"), "n", "nulls", F.bit_count("bits").cast("long").alias("kinds"), F.coalesce("samples", F.lit("")).alias("samples"))
