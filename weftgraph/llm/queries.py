"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, decontam, langid, licences, linededup, paritysketch, quality, ranker, reputation, toxicity
from weftgraph.llm.common import held_out

VOCAB = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    out = langid.predict(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "family_pred")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = ranker.score(docs, ranker.learn(docs, table(spark, sf_dir, "labels"), lambda c: ~held_out(c, 4, 2)))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= ranker.CUT).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dropped_by_document(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paritysketch.near_duplicates(table(spark, sf_dir, "documents"), paritysketch.Join(words=3, num=90))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda c: ~held_out(c, 5, 0))
    out = toxicity.score(docs, lexicon)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")


RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is what its own html says: spam words or junk signs make it bad."""
    pages = table(spark, sf_dir, "pages")
    out = reputation.judge(pages, reputation.page_outcomes(pages), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("bad_share", 6).alias("bad_share"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source/lang/hundred/number; every twentieth is its directory's licence file."""
    docs = table(spark, sf_dir, "documents")
    licence_file = F.col("doc_id") % 20 == 0
    number = F.col("doc_id").cast("string")
    below = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"))
    above = F.when(F.col("doc_id") % 60 == 0, F.col("source")).otherwise(below)
    # A null source, language or number makes the path null.
    path = F.when(licence_file, F.concat(above, F.lit("/LICENSE."), number)).otherwise(F.concat(below, F.lit("/"), number, F.lit(".txt")))
    return licences.scan(docs.select("doc_id", path.alias("path"), "text", F.coalesce(licence_file, F.lit(False)).alias("is_licence_file")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.item_digests(found)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCAB), public_tokenizers.PATTERN)
    return bpe.token_digests(encoded)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language, op2_quality_rules, op3_quality_ranking, op4_line_dedup, op5_jaccard_join, op6_toxicity, op7_host_reputation, op8_decontaminate, op9_byte_bpe, op10_licences)}

#: Template vectors as SQL values; the figures come from the fixed texts of the templates.
_IDF, _VECTORS = licences.template_weights(licences.TEMPLATES)
_IDF_SQL = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in _IDF.items())
_VECTOR_SQL = ", ".join(f"('{w}', {i}, '{k}', {x!r}::DOUBLE)" for i, (k, v) in enumerate(_VECTORS) for w, x in v.items())
_STRENGTH = "greatest(0.5, least(1000.0, coalesce(CASE WHEN sum((k - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * m * (1 - m) * (n - 1)), 0) > 0 THEN sum(n * m * (1 - m) * (n - 1)) / sum((k - n * m) ** 2 - n * m * (1 - m)) - 1 ELSE 1000.0 END, 1000.0)))"

ORACLES: dict[str, str] = {
    "op4_line_dedup": r"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
occ AS (SELECT doc_id, i - 1 AS no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs) WHERE length(ls[i]) >= 20),
firsts AS (SELECT line, length(line) AS n, min((doc_id, no)) AS first FROM occ GROUP BY line),
near AS (
  SELECT a.line, b.first FROM firsts a JOIN firsts b ON a.n = b.n OR a.n = b.n + 1 OR a.n = b.n + 2 OR a.n = b.n - 1 OR a.n = b.n - 2
  WHERE a.line <> b.line AND levenshtein(a.line, b.line) <= 2),
lim AS (SELECT line, min(first) AS first FROM (SELECT line, first FROM firsts UNION ALL SELECT line, first FROM near) GROUP BY line),
gone AS (SELECT doc_id, list_sort(list(DISTINCT no::INTEGER)) AS dropped FROM occ JOIN lim USING (line) WHERE (doc_id, no) > lim.first GROUP BY doc_id)
SELECT d.doc_id, d.n_lines, coalesce(len(dropped), 0)::BIGINT AS n_dropped, coalesce(dropped, []::INTEGER[]) AS dropped
FROM (SELECT doc_id, max(coalesce(len(ls), 0))::BIGINT AS n_lines FROM docs GROUP BY doc_id) d LEFT JOIN gone USING (doc_id)
""",
    "op5_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS digest FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT doc_id, doc_id FROM w),
r AS (SELECT a AS s, b AS t FROM e UNION SELECT r.s, e.b FROM r JOIN e ON r.t = e.a),
c AS (SELECT s AS doc_id, min(t) AS component_id FROM r GROUP BY s),
d AS (SELECT digest, min(doc_id) AS class_id FROM n GROUP BY digest)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(class_id, w.doc_id) AS class_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN d USING (digest) JOIN c ON c.doc_id = w.doc_id
""",
    "op7_host_reputation": rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
t AS (SELECT page_id, html, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages),
o AS (
  SELECT page_id, CASE WHEN html IS NOT NULL THEN (
    regexp_matches(html, '(^|[^0-9A-Za-z])(?i:{"|".join(reputation.SPAM_WORDS)})([^0-9A-Za-z]|$)')
    OR (length(t) - length(translate(t, '{reputation.JUNK_SIGNS}', ''))) * 100 > length(t) * 5)::INTEGER END AS bad FROM t),
h AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k FROM p LEFT JOIN o USING (page_id) GROUP BY host),
hs AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix FROM h),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hs GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 20) FROM d) AS m FROM d GROUP BY suffix),
sa AS (SELECT suffix, (k + a * m) / (n + a) AS m FROM s, (SELECT {_STRENGTH} AS a FROM s)),
dm AS (SELECT domain, n, k, m FROM d JOIN sa USING (suffix)),
da AS (SELECT domain, (k + a * m) / (n + a) AS m FROM dm, (SELECT {_STRENGTH} AS a FROM dm)),
hm AS (SELECT host, n, k, m FROM hs JOIN da USING (domain)),
ha AS (SELECT host, (k + a * m) / (n + a) AS mean, n + a AS total FROM hm, (SELECT {_STRENGTH} AS a FROM hm)),
r AS (SELECT * FROM (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) AS t(rule, rhost, rpath, action)),
m AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM p JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN mean - 1.2816 * sqrt(mean * (1 - mean) / (total + 1)) > 0.30 THEN 'block' ELSE 'allow' END) AS verdict,
       round(mean, 6) AS bad_share
FROM p LEFT JOIN m USING (page_id) LEFT JOIN ha USING (host)
""",
    "op10_licences": rf"""
WITH f AS (
  SELECT doc_id, doc_id % 20 = 0 AS whole, text,
         CASE WHEN doc_id % 60 = 0 THEN source ELSE source || '/' || lang || '/' || (doc_id // 100)::VARCHAR END AS dir,
         CASE WHEN doc_id % 20 = 0 THEN 'LICENSE.' || doc_id::VARCHAR ELSE doc_id::VARCHAR || '.txt' END AS name
  FROM documents),
fp AS (SELECT *, dir || '/' || name AS path FROM f),
idf AS (SELECT * FROM (VALUES {_IDF_SQL}) AS t(word, idf)),
vec AS (SELECT * FROM (VALUES {_VECTOR_SQL}) AS t(word, template, licence, weight)),
seg AS (
  SELECT DISTINCT doc_id, path, dir, whole, segment
  FROM (SELECT doc_id, path, dir, whole, unnest(string_split(text, chr(10))) AS segment FROM fp) WHERE length(segment) > 0
  UNION SELECT doc_id, path, dir, whole, text FROM fp WHERE whole AND length(text) > 0),
tf AS (
  SELECT segment, word, count(*) AS tf
  FROM (SELECT segment, unnest(regexp_extract_all(translate(segment, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([0-9a-z]+(?:\.[0-9]+)*)')) AS word FROM (SELECT DISTINCT segment FROM seg))
  GROUP BY ALL),
w AS (SELECT segment, tf.word, (1 + ln(tf)) * coalesce(idf, ln(1 + {len(_VECTORS)}) + 1) AS x FROM tf LEFT JOIN idf ON tf.word = idf.word),
norm AS (SELECT segment, sqrt(sum(x * x)) AS norm FROM w GROUP BY segment),
sc AS (
  SELECT segment, licence, round(dot / norm, 6) AS score
  FROM (SELECT segment, template, licence, sum(x * weight) AS dot FROM w JOIN vec USING (word) GROUP BY ALL) JOIN norm USING (segment)),
own AS (
  SELECT doc_id, path, dir, whole, score, licence AS own_licence
  FROM seg JOIN sc USING (segment) WHERE score >= {licences.THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY score DESC, licence) = 1),
decl AS (SELECT dir AS above, own_licence AS licence FROM own WHERE whole QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, own_licence) = 1),
near AS (
  SELECT d.dir, above, licence FROM (SELECT DISTINCT dir FROM fp) d JOIN decl ON d.dir = above OR starts_with(d.dir, above || '/')
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(above) DESC) = 1)
SELECT fp.doc_id, fp.path, own_licence, score, coalesce(own_licence, near.licence) AS licence, CASE WHEN own_licence IS NULL THEN above END AS inherited_from
FROM fp LEFT JOIN own ON fp.doc_id IS NOT DISTINCT FROM own.doc_id AND fp.path IS NOT DISTINCT FROM own.path LEFT JOIN near ON fp.dir = near.dir
""",
    "op8_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark),
bwin AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS m, array_to_string(w[j:j + least(8, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS j FROM bw WHERE len(w) > 0)),
dwin AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM bwin) WHERE len(w) >= m)),
found AS (SELECT d.doc_id, b.item_id, d.i, d.m FROM dwin d JOIN bwin b ON d.m = b.m AND d.win = b.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
