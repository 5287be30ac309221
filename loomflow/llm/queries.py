"""The numbered queries: each applies its operator to whole tables and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomflow.llm.tables import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomflow.llm.sentencepiece_codec import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"), payload=False)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomflow.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), texts=False)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomflow.llm.quality_rules import FEATURES, quality

    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *FEATURES, "base_failed", "kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomflow.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomflow.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomflow.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomflow.llm.lm_scoring import score

    return score(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomflow.llm.simhash import near_duplicates

    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomflow.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomflow.llm.decontamination import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomflow.llm.fill_in_middle import fill_in_middle, restored

    got = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomflow.llm.source_mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("times")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomflow.llm.embedding_whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_substring_dedup, op3_quality_rules, op4_language_id, op5_token_counts, op6_toxicity, op7_lm_scoring, op8_simhash, op9_secret_scan, op10_decontamination,
        op11_fill_in_middle, op12_source_mixing, op13_embedding_whitening,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _mixing_sql() -> str:
    """Water level by sorted ratios in place of passes, thresholds by sorted running sums in place of histograms."""
    parts, rounds = [], 6
    for k in range(rounds):
        taken = "false" if not k else " OR ".join(f"(size <= r{j} AND (w{j} IS NULL OR u < w{j}))" for j in range(k))
        live = f"r{k} > 0" + (f" AND r{k} * 1000 > budget" if k else "")
        parts += [
            f"c{k} AS (SELECT k, u, size, r{k} AS r, sum(size) OVER (PARTITION BY k ORDER BY u RANGE UNBOUNDED PRECEDING) AS cum FROM rws JOIN g{k} USING (k) WHERE {live} AND size <= r{k} AND NOT ({taken}))",
            f"t{k} AS (SELECT k, min(CASE WHEN cum > r THEN u END) AS under, coalesce(max(CASE WHEN cum <= r THEN cum END), 0)::BIGINT AS found FROM c{k} GROUP BY k)",
            f"g{k + 1} AS (SELECT g.* REPLACE (CASE WHEN t.k IS NULL THEN 0 ELSE r{k} END AS r{k}), t.under AS w{k}, r{k} - coalesce(found, 0) AS r{k + 1} FROM g{k} g LEFT JOIN t{k} t USING (k))",
        ]
    taken = " OR ".join(f"(size <= r{j} AND (w{j} IS NULL OR u < w{j}))" for j in range(rounds))
    return rf"""
WITH own AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS k, len({_WORDS})::BIGINT AS size, ('0x' || substr(md5('12:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS u FROM documents),
src AS (SELECT source, k, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM own GROUP BY source, k),
lev AS (SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER o, 0) AS below, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest_w FROM src WINDOW o AS (ORDER BY most::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cap AS (SELECT *, w * below > most * rest_w AS capped FROM lev),
fin AS (SELECT source, k, source_size, CASE WHEN capped THEN most::DOUBLE ELSE (w * (SELECT sum(source_size) - coalesce(sum(most) FILTER (capped), 0) FROM cap))::DOUBLE / (SELECT sum(w) FILTER (NOT capped) FROM cap) END AS target FROM cap),
bud AS (SELECT *, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN least(3, round(target)::BIGINT // source_size) ELSE 0 END AS passes FROM fin),
rws AS (SELECT k, u, size FROM own WHERE size > 0),
g0 AS (SELECT k, budget, CASE WHEN passes < 3 THEN budget - passes * source_size ELSE 0 END AS r0 FROM bud),
{", ".join(parts)},
ov AS (SELECT k, min(size * 1152921504606846976::HUGEINT + u) AS key FROM rws JOIN g{rounds} USING (k) WHERE size < 2 * r{rounds} AND NOT ({taken}) GROUP BY k),
pick AS (SELECT k, key FROM rws JOIN ov USING (k) JOIN g{rounds} USING (k) WHERE size * 1152921504606846976::HUGEINT + u = key GROUP BY k, key HAVING sum(size) < 2 * any_value(r{rounds}))
SELECT doc_id, size, source_size, target, (size * CASE WHEN size > 0 THEN passes + CASE WHEN ({taken}) OR coalesce(size * 1152921504606846976::HUGEINT + u = key, false) THEN 1 ELSE 0 END ELSE 0 END)::BIGINT AS taken
FROM own JOIN bud USING (k) JOIN g{rounds} USING (k) LEFT JOIN pick USING (k)"""


#: The queries that SQL can express; ids of `documents` are distinct and not null.
ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
t AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)),
owner AS (SELECT win, min(doc_id) AS low FROM t GROUP BY win),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS at FROM t JOIN owner USING (win) WHERE low < doc_id),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at FROM d),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.at) AS text, count(*) AS n FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.at = w.at WHERE gone.at IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op3_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, sum(n)::BIGINT AS n_lines, sum(n - 1)::BIGINT AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS n FROM lines GROUP BY ALL) GROUP BY doc_id),
t AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, win FROM t GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT doc_id, i, unnest(range(5)) AS k FROM t JOIN twice USING (doc_id, win)) GROUP BY doc_id),
f AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
 len([x FOR x IN words IF regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]')]) AS lettered, length(regexp_replace(text, '[^.,;:!?]', '', 'g')) AS points,
 length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS uppers FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 5 * lettered < 4 * n_words OR points > n_words
  OR (n_dup_lines > 3 AND 2 * n_dup_lines > n_lines) OR (letters > 20 AND 10 * uppers > 3 * letters)) AS kept FROM b""",
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, {_PLAIN_WORDS} AS words FROM documents),
b AS (SELECT item_id, words, least(len(words), 10) AS m FROM (SELECT item_id, {_PLAIN_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(words[i:i + m - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(words) - m + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT m FROM win),
t AS (SELECT doc_id, m, i, array_to_string(words[i:i + m - 1], ' ') AS w FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM d, sizes)),
hit AS (SELECT doc_id, t.m, i, item_id FROM t JOIN win USING (m, w)),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, unnest(range(m)) AS k FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
c AS (SELECT *, len(u) AS n, (('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1))::BIGINT AS a, (('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1))::BIGINT AS b,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(u[:least(a, b)], ''), '') AS pre, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS mid, coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op12_source_mixing": _mixing_sql(),
}
