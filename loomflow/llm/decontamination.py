"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows are sets of word shingles. Containment of a whole window needs all
of its shingles, so the necessary prefix, with shingles in order of rarity in the
corpus, is the rarest one. Only its occurrences are joined; where they place the
window beyond either end of a document (positional and length bounds) they drop, and
the rest are verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.llm.tables import row_key, written

WINDOW, SHINGLE = 10, 3
#: Most distinct shingles (8 bytes each) of the benchmark that are broadcast; beyond, the join shuffles.
BROADCAST_SHINGLES = 2_000_000

_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased and other letters as they are; null has none."""
    fold = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER))
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), _SEPARATORS), ""), fold)


def _shingles(words: Column, size: int) -> Column:
    """Hashes of `size` consecutive words, in order of place."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))
    return F.when(n >= size, hashes).otherwise(F.array().cast("array<bigint>"))


def windows_of(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, wid, w): each item's windows; a shorter item is one window."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("m", F.least(F.size("words"), F.lit(window)))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1))
    return items.select("item", "words", "m", starts.alias("s")).select("item", F.expr("slice(words, s, m)").alias("w")).select("item", F.xxhash64("w").alias("wid"), "w")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id_col, row_key, n_words, n_hit, n_items, items_sha256, contaminated) of each row of `docs`.

    A word is hit if a window of some item lies over it. Null and empty texts have no words
    and no hits; items without words have no windows; those of null id hit words, but
    have no name to count or list; equal windows of several items count for each. Identical
    rows share a row_key (128 bits of id and text) and get the same result each. An empty table on either side gives no hits. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    items = written(windows_of(benchmark, item_col, item_text, window).distinct(), "windows")
    windows = items.dropDuplicates(["wid", "w"]).select("wid", "w").withColumn("size", F.least(F.size("w"), F.lit(SHINGLE)))
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # 1 to SHINGLE
    parts = [windows.where(F.col("size") == s).select("wid", "w", F.posexplode(_shingles(F.col("w"), s)).alias("offset", "h")) for s in sizes]
    if not parts:
        return own.select(F.col("id").alias(id_col), "row_key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    tokens = parts[0]
    for p in parts[1:]:
        tokens = tokens.unionByName(p)
    wanted = written(tokens.select("h").distinct(), "shingles")
    if wanted.count() <= BROADCAST_SHINGLES:
        wanted = F.broadcast(wanted)
    split = own.select("row_key", words_of(F.col("text")).alias("words"))
    found = [split.select("row_key", F.size("words").alias("n"), F.posexplode(_shingles(F.col("words"), s)).alias("pos", "h")).join(wanted, "h", "left_semi") for s in sizes]
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    hits = written(hits, "postings")
    rarity = hits.groupBy("h").agg(F.count("*").alias("df"))
    prefix = tokens.join(rarity, "h", "left").groupBy("wid", "w").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "offset")).alias("rare"))
    prefix = prefix.where("rare.df > 0").select("wid", "w", F.col("rare.h").alias("h"), F.col("rare.offset").alias("offset"))
    at = F.col("pos") - F.col("offset")
    candidates = hits.join(prefix, "h").where((at >= 0) & (at + F.size("w") <= F.col("n"))).select("row_key", at.alias("at"), "wid", "w").distinct()
    by_row = candidates.groupBy("row_key").agg(F.collect_list(F.struct("at", "wid", "w")).alias("candidates"))
    joined = own.join(by_row, "row_key", "left").withColumn("words", words_of(F.col("text")))
    verified = F.filter("candidates", lambda c: F.slice(F.col("words"), c["at"] + 1, F.size(c["w"])) == c["w"])
    spans = F.sort_array(F.transform(F.col("seen"), lambda c: F.struct(c["at"].alias("at"), (c["at"] + F.size(c["w"])).alias("end"))))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["at"]))).alias("n")),
        lambda acc: acc["n"],
    )
    seen = joined.select("id", "row_key", F.size("words").cast("long").alias("n_words"), verified.alias("seen"))
    rows = seen.select("id", "row_key", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"), F.array_distinct(F.transform("seen", lambda c: F.struct(c["wid"].alias("wid"), c["w"].alias("w")))).alias("windows"))
    rows = written(rows, "hits")
    named = rows.where("n_hit > 0").select("row_key", F.explode("windows").alias("x")).select("row_key", "x.wid", "x.w").distinct().join(items.where("item is not null"), ["wid", "w"])
    named = named.groupBy("row_key").agg(F.array_sort(F.collect_set("item")).alias("names")).select("row_key", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"))
    out = rows.drop("windows").join(named, "row_key", "left")
    return out.select(F.col("id").alias(id_col), "row_key", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
