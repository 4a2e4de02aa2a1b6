"""The queries of this subpackage over the supplied tables, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemesh.llm import (bpe_trie, id_coder, language_centroids, library_ids, packing_nnls, pii_semicrf, quality_rules,
                          redirect_verdicts, simhash_golay, source_divergence, substring_dedup, token_alignment,
                          topk_segments, toxicity_fm)
from casemesh.llm.redirect_verdicts import Rule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_TOKENIZER, BYTE_TOKENIZER, PIECE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
URL_RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"),
             Rule("org", "/fr/", "allow")]


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and whether a learned decision list keeps it."""
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge_quality(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op2_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    groups = simhash_golay.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash_golay.as_hex("fp").alias("fingerprint"), "component_id")


@query
def op3_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by its nearest centroid."""
    docs = table(spark, sf_dir, "documents")
    held = language_centroids.held_out()
    model = language_centroids.fit_languages(docs, ~held)
    return language_centroids.judge_languages(docs, model).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op4_packing_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 ids."""
    text = library_ids.tokenizer_text(public_tokenizers.path(WORD_TOKENIZER))
    return packing_nnls.pack(table(spark, sf_dir, "documents"), text)


@query
def op5_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    text = library_ids.tokenizer_text(public_tokenizers.path(WORD_TOKENIZER))
    coded = bpe_trie.decode_ids(bpe_trie.encode_texts(table(spark, sf_dir, "documents"), text), text)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by a factorization machine."""
    docs = table(spark, sf_dir, "documents")
    held = toxicity_fm.held_out()
    machine = toxicity_fm.fit_machine(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity_fm.score_toxicity(docs, machine).select(
        "doc_id", held.alias("held_out"), "score",
        (F.col("score") >= toxicity_fm.THRESHOLD).cast("int").alias("predicted"))


@query
def op7_topk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products of every hundredth vector against all."""
    return topk_segments.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op7_topk_segments"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.p, c.p), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.p) = len(c.p)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op8_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: pattern matches and the field's further spans."""
    docs = table(spark, sf_dir, "documents")
    found = pii_semicrf.find_spans(docs, pii_semicrf.fit_field(docs))

    def digest(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii_semicrf.KINDS]
    return found.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"),
                        digest(F.col("spans")).alias("spans"))


@query
def op9_id_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to range-coded files, and what the files hold for each document."""
    text = library_ids.tokenizer_text(public_tokenizers.path(BYTE_TOKENIZER))
    path = id_coder.ids_path(spark)
    id_coder.write_ids(table(spark, sf_dir, "documents"), text, path)
    return id_coder.read_ids(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op10_redirect_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page by rules and, where none fits, by its equivalents."""
    return redirect_verdicts.judge_pages(table(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op10_redirect_verdicts"] = r"""
WITH RECURSIVE rules(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), cut AS (
  SELECT page_id, url, html,
         CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url[strpos(url, '://') + 3:], '^([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url[strpos(url, '://') + 3:], '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), plain AS (
  SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(regexp_replace(path, '\.html?$', ''), '/+$', '')
         || coalesce('?' || nullif(array_to_string(list_filter(string_split(
              regexp_extract(url, '^[^#?]*\?([^#]*)', 1), '&'),
              lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')), '&'), ''), '') END AS node
  FROM cut
), targets AS (
  SELECT node AS source, replace(regexp_extract(tag, '(?i)href\s*=\s*"([^"]*)"', 1), '&amp;', '&') AS link
  FROM (SELECT node, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS tag FROM plain WHERE node IS NOT NULL)
  WHERE regexp_matches(tag, '(?i)rel\s*=\s*"canonical"')
), links AS (
  SELECT source, regexp_replace(regexp_replace(regexp_extract(link, '://([^?#]*)', 1), '\.html?$', ''), '/+$', '') AS target
  FROM targets WHERE link LIKE '%://%'
), both_ways AS (
  SELECT source AS a, target AS b FROM links UNION SELECT target, source FROM links
), reach(a, b) AS (
  SELECT node, node FROM plain WHERE node IS NOT NULL
  UNION
  SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), ruled AS (
  SELECT p.page_id, p.url, p.host, p.path, p.node,
         first(r.host || r.path ORDER BY length(r.host || r.path) DESC) FILTER (r.host IS NOT NULL) AS rule,
         first(r.verdict ORDER BY length(r.host || r.path) DESC) FILTER (r.host IS NOT NULL) AS verdict
  FROM plain p LEFT JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)
  GROUP BY ALL
), spread AS (
  SELECT reach.a AS node, bool_or(ruled.verdict = 'allow') AS allowed
  FROM reach JOIN ruled ON reach.b = ruled.node WHERE ruled.rule IS NOT NULL GROUP BY reach.a
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN verdict WHEN allowed THEN 'allow' WHEN NOT allowed THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN spread ON ruled.node = spread.node
"""


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of two tokenizers' ids over every document, and how common their linked pairs are."""
    text = library_ids.tokenizer_text(public_tokenizers.path(BYTE_TOKENIZER))
    with open(public_tokenizers.path(PIECE_TOKENIZER), "rb") as f:
        return token_alignment.align_texts(table(spark, sf_dir, "documents"), text, f.read())


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of every language differ in their words, and the words that set each apart."""
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


ORACLES["op12_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), found AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), kinds AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL
), sources AS (
  SELECT DISTINCT lang, source FROM docs
), totals AS (
  SELECT s.lang, s.source, coalesce(sum(n), 0) AS total FROM sources s LEFT JOIN counted c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
         1 + (CAST(coalesce(c.n, 0) + 2 AS HUGEINT) * 1000000000) // CAST(t.total + 2 * v AS HUGEINT) AS p
  FROM totals t JOIN kept k USING (lang) JOIN kinds USING (lang)
  LEFT JOIN counted c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), whole AS (
  SELECT lang, sum(total) AS total FROM totals GROUP BY lang
), q AS (
  SELECT lang, term, 1 + (CAST(sum(n) + 2 AS HUGEINT) * 1000000000) // CAST(any_value(w.total) + 2 * any_value(v) AS HUGEINT) AS q
  FROM p JOIN whole w USING (lang) JOIN kinds USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(d.value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) d
    ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
), terms AS (
  SELECT p.lang, p.source, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value
  FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM terms
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's words that no earlier passage repeats."""
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return kept.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
