"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Each row has a hash. A source with a budget of q whole passes and a rest gives every
row q times, and once more to rows whose hash lies under a threshold. The threshold is
found by sums of sizes by source and hash bucket: running sums over the buckets of one
source show which bucket the budget ends in; only that bucket is refined, by the next
bits of the hash, and at last by the hashes themselves. Rows are filtered, never sorted.

A threshold stops before the row that would exceed the budget. What is left goes to
rows above it that fit, by a threshold of their own, and at last, where that is nearer,
to the least row that does not fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomflow.llm.tables import written

#: Bits of a hash, and of each level's bucket but the last, which has all the bits that are left.
BITS, LEVEL, LEVELS = 60, 12, 2
#: Thresholds of a source at most; one in `NEAR` of its target is near enough for no further one.
ROUNDS, NEAR = 6, 1000
#: A row is taken so often at most.
REPEATS = 3

_SPACE = " \t\n\x0b\x0c\r"


def size_of(text: Column) -> Column:
    """Number of words of a text: each is put down as one letter, and the white space goes. Null has none."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x"), _SPACE, "")).cast("long")


def hash_of(row_id: Column, text: Column, seed: int) -> Column:
    """60 bits of a row's id and text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))), 1, BITS // 4), 16, 10).cast("long")


def weighed(rows: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, weight): sources in order of code points, null last, and the weights repeating.

    The order is found by ranges of names: places within a range, and the sizes of the ranges before it.
    """
    sources = written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    named = sources.where("source is not null").repartitionByRange(F.col("source")).withColumn("range", F.spark_partition_id())
    named = written(named, "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    ends = named.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("source")) - 1
    ranked = named.withColumn("place", place).join(ends, "range").select("source", "source_size", (F.col("place") + F.col("before")).alias("place"))
    last = sources.where("source is null").crossJoin(named.agg(F.count("*").alias("place"))).select("source", "source_size", "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    return ranked.unionByName(last).select("source", "source_size", weight.alias("weight"))


def targets(sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """`sources` with target (double): the total by weight, at most `repeats` times a source's size, the excess shared again.

    Each pass finds what the capped sources leave to the weights of the others, in whole
    numbers; the driver gets these two sums alone. Passes end when no source is above.
    """
    most = F.col("source_size") * repeats
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    left, weight = total, sources.agg(F.sum("weight")).first()[0] or 1
    exact = lambda x: x.cast("decimal(19,0)")  # noqa: E731  two make 38 digits
    while True:
        over = exact(F.col("weight")) * exact(F.lit(left)) > exact(most) * exact(F.lit(weight))  # its share is above its cap
        got = sources.agg(F.coalesce(F.sum(F.when(over, most)), F.lit(0)).alias("capped"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(1)).alias("weight")).first()
        if (total - got["capped"], got["weight"]) == (left, weight):
            return sources.withColumn("target", F.when(over, most.cast("double")).otherwise(F.col("weight") * F.lit(left) / F.lit(weight)))
        left, weight = total - got["capped"], got["weight"]


def _threshold(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(k, under, found): `found`, the largest sum of sizes of a source's rows of hash under `under` that is at most `rest`.

    `rows` is (k, u, size), `budgets` (k, rest). `under` is null where all rows fit.
    """
    seen, base, found = budgets.withColumn("prefix", F.lit(0).cast("long")), rows, None
    for level in range(LEVELS + 1):
        low = BITS - LEVEL * (level + 1) if level < LEVELS else 0
        bucket = F.shiftright("u", low)
        if level:
            base = base.join(seen.select("k", "prefix"), "k").where(F.shiftright("u", BITS - LEVEL * level) == F.col("prefix")).drop("prefix")
            base = written(base, "bucket") if level == 1 else base
        sums = base.groupBy("k", bucket.alias("bucket")).agg(F.sum("size").alias("sum"))
        before = F.coalesce(F.sum("sum").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        running = written(sums.withColumn("before", before).join(seen.select("k", "rest"), "k"), "sums")
        ends = running.where(F.col("before") + F.col("sum") > F.col("rest")).groupBy("k").agg(F.min(F.struct("bucket", "before")).alias("x"))
        if level == 0:
            whole = running.groupBy("k").agg(F.max(F.col("before") + F.col("sum")).alias("whole"))
            found = whole.join(ends.select("k", F.lit(True).alias("ended")), "k", "left").where("ended is null").select("k", F.lit(None).cast("long").alias("under"), F.col("whole").alias("found"))
        seen = seen.join(ends, "k").select("k", (F.col("rest") - F.col("x.before")).alias("rest"), F.col("x.bucket").alias("prefix"))
    return found.unionByName(seen.join(budgets.select("k", F.col("rest").alias("budget")), "k").select("k", F.col("prefix").alias("under"), (F.col("budget") - F.col("rest")).alias("found")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: int = 12, repeats: int = REPEATS, rounds: int = ROUNDS) -> DataFrame:
    """(id_col, size, source_size, target, times, taken) of each row: its words, those of its source, its source's target, and how often it is taken.

    A source's taken words differ from its target by about half its least row that was
    not taken once more, where `rounds` thresholds reach so far. Rows of equal id and
    text are taken alike; null sources are one source; a null or empty text has size 0
    and takes nothing; in an empty table or one without words all targets are 0. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col), F.col(text_col), seed).alias("u"))
    own = written(own, "sizes")
    goal = targets(written(weighed(own, weights), "weights"), repeats)
    budget = F.round("target").cast("long")
    goal = goal.withColumn("k", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("passes", F.when(F.col("source_size") > 0, F.expr("least(CAST(round(target) AS LONG) div source_size, %d)" % repeats)).otherwise(F.lit(0)).cast("long"))
    goal = written(goal.withColumn("rest", F.when(F.col("passes") < repeats, budget - F.col("passes") * F.col("source_size")).otherwise(0)), "targets")

    rows = own.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("k"), "u", "size").where("size > 0")
    rests = goal.select("k", "rest", F.round("target").cast("long").alias("budget"), F.array().cast("array<struct<rest:bigint,under:bigint>>").alias("rules"))
    chosen = lambda rules: F.exists(rules, lambda x: (F.col("size") <= x["rest"]) & (x["under"].isNull() | (F.col("u") < x["under"])))
    for k in range(rounds):
        active = (F.col("rest") > 0) & ((F.col("rest") * NEAR > F.col("budget")) if k else F.lit(True))
        if k and not rests.where(active).limit(1).count():
            break
        fit = rows.join(rests.where(active).select("k", "rest", "rules"), "k").where((F.col("size") <= F.col("rest")) & ~chosen(F.col("rules"))).select("k", "u", "size")
        got = _threshold(fit, rests.where(active).select("k", "rest"))
        rule = F.array(F.struct("rest", "under"))
        rests = written(rests.join(got, "k", "left").select("k", (F.col("rest") - F.coalesce("found", F.lit(0))).alias("rest"), "budget", F.when(F.col("found").isNotNull(), F.concat("rules", rule)).otherwise(F.col("rules")).alias("rules")), "rests")
    # The least row that does not fit, if that leaves less above the target than is missing now.
    over = rows.join(rests, "k").where(~chosen(F.col("rules")) & (F.col("size") < 2 * F.col("rest"))).groupBy("k").agg(F.min(F.struct("size", "u")).alias("last"))
    alike = rows.join(over, "k").where((F.col("size") == F.col("last.size")) & (F.col("u") == F.col("last.u"))).groupBy("k").agg(F.sum("size").alias("sum"), F.first("last").alias("last"))
    rests = rests.join(alike, "k", "left").select("k", "rules", F.when(F.col("sum") < 2 * F.col("rest"), F.col("last")).alias("last"))
    plan = goal.join(rests, "k").select("source", "source_size", "target", "passes", "rules", "last")
    out = own.alias("o").join(plan.alias("p"), F.col("o.source").eqNullSafe(F.col("p.source")))
    once = chosen(F.col("rules")) | F.coalesce((F.col("size") == F.col("last.size")) & (F.col("u") == F.col("last.u")), F.lit(False))
    times = F.when(F.col("size") > 0, F.col("passes") + once.cast("long")).otherwise(F.lit(0).cast("long"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))
