"""The numbered operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.llm import (
    embedding_dedup, html_extract, mixing, packing, periodic_runs, pii, quality_classifier, quality_rules, simhash, source_audit,
    substring_dedup, token_files, url_filter,
)
from gantry.llm.common import reachable, settled, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = settled(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words().alias("size")), "mix")
    targets = settled(mixing.source_targets(sized), "mix")
    return mixing.mix(sized, targets).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", simhash.hex_digits(F.col("fingerprint")))


#: The rules that the query applies, as (host and path, verdict).
URL_RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[pii.count_of("base", k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.digest("base"), 256).alias("base_sha256"), pii.digest("spans").alias("spans"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """The places that the query reads a text's words from: one text in ten goes on with a period, by its id."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return None
    places, a = np.arange(n), g % n
    places[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return places


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.detect(table(spark, sf_dir, "documents"), looped)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # The longest, of those the first, of those the one of the least period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return found.withColumn("_b", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("_b.s")).alias("start"), F.col("_b.l").alias("length"), (-F.col("_b.p")).alias("period"),
        F.expr("1000 * _b.l div -_b.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plans = {
        "op1_mixing": op1_mixing,
        "op2_quality_rules": op2_quality_rules,
        "op3_simhash": op3_simhash,
        "op4_url_filter": op4_url_filter,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_html_extract": op6_html_extract,
        "op7_packing": op7_packing,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_token_files": op9_token_files,
        "op10_pii": op10_pii,
        "op11_source_divergence": op11_source_divergence,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_quality_classifier": op13_quality_classifier,
    }
    return {name: (lambda s, d, plan=plan: plan(reachable(s), d)) for name, plan in plans.items()}


OP1_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM per_source
),
-- The level at which all targets, each stopping at 3 times its source, use up the whole:
-- the sources that stop are found by trying each one's own limit as the level.
tried AS (
  SELECT t.source, sum(least(3 * o.source_size, 3.0::DOUBLE * t.source_size / t.weight * o.weight)) AS used
  FROM weighted t CROSS JOIN weighted o GROUP BY t.source
),
whole AS (SELECT sum(source_size)::BIGINT AS total FROM weighted),
stopped AS (
  SELECT w.*, round(used) <= total AS at_limit FROM weighted w JOIN tried t ON w.source IS NOT DISTINCT FROM t.source CROSS JOIN whole
),
level AS (
  SELECT (total - coalesce(sum(3 * source_size) FILTER (at_limit), 0))::BIGINT
       / (sum(weight) FILTER (NOT at_limit))::BIGINT AS l
  FROM stopped CROSS JOIN whole GROUP BY total
),
targets AS (
  SELECT source, source_size, CASE WHEN at_limit THEN (3 * source_size)::DOUBLE ELSE least(l * weight, (3 * source_size)::DOUBLE) END AS target
  FROM stopped CROSS JOIN level
),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets),
drawn AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, floor(rate)::BIGINT + CASE
    WHEN ('0x' || substr(md5('0:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate)
    THEN 1 ELSE 0 END AS copies
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM drawn
"""


OP4_SQL = """
WITH rules(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
),
parts AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
fits AS (
  SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)
"""

OP5_SQL = """
WITH RECURSIVE good AS (
  SELECT row_number() OVER () AS n, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
),
usable AS (
  SELECT n, vec_id, label, v FROM good
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = len(v)
    AND list_dot_product(v, v) > 0
),
linked AS (
  SELECT a.n AS a, b.n AS b, b.vec_id AS b_id FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.n <> b.n
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.93
),
reach AS (
  SELECT a AS n, b AS other FROM linked
  UNION
  SELECT r.n, l.b FROM reach r JOIN linked l ON l.a = r.other
),
least AS (SELECT r.n, min(g.vec_id) AS least FROM reach r JOIN good g ON g.n = r.other GROUP BY r.n),
counted AS (SELECT a AS n, count(*) AS n_links FROM linked GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(least(least, vec_id), vec_id, least) AS component_id,
  vec_id IS NOT DISTINCT FROM coalesce(least(least, vec_id), vec_id, least) AS kept
FROM good LEFT JOIN least USING (n) LEFT JOIN counted USING (n)
"""


OP8_SQL = """
WITH split AS (
  SELECT doc_id, row_number() OVER () AS n, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
),
windows AS (
  SELECT n, doc_id, i, w[i:i + 12] AS win FROM (SELECT n, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM split)
),
least AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win),
gone AS (
  SELECT n, list_distinct(flatten(list(range(i, i + 13)))) AS places
  FROM windows JOIN least USING (win) WHERE first < coalesce(doc_id, 9223372036854775807) GROUP BY n
),
kept AS (
  SELECT s.n, len(places) AS n_removed,
    list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(places, x[2])), lambda x: x[1]) AS k
  FROM split s JOIN gone g USING (n)
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n_removed IS NULL THEN w ELSE k END, ' ')) AS kept_sha256
FROM split LEFT JOIN kept USING (n)
"""


OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
),
words AS (
  SELECT n, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT n, lang, source, unnest(w) AS term FROM d)
),
kept AS (SELECT lang, term, count(*) AS lang_c FROM words GROUP BY lang, term HAVING count(DISTINCT n) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(lang_c)::BIGINT AS lang_total FROM kept GROUP BY lang),
parts AS (SELECT DISTINCT lang, source FROM d),
counted AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
filled AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.lang_c, s.v, s.lang_total,
    sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang, g.source)::BIGINT AS total
  FROM parts g JOIN kept k USING (lang) JOIN sizes s USING (lang)
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
shares AS (
  SELECT lang, source, term, c, (1 + (1000000000::HUGEINT * (c + 2)) // (total + 2 * v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (lang_c + 2)) // (lang_total + 2 * v))::BIGINT AS q
  FROM filled
),
met AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0) AS value
  FROM parts a JOIN parts b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN met m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value,
  row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": OP1_SQL, "op4_url_filter": OP4_SQL, "op5_embedding_dedup": OP5_SQL, "op8_substring_dedup": OP8_SQL,
        "op11_source_divergence": OP11_SQL,
    }
