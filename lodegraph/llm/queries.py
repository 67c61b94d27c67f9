"""The registered queries of this package's operators, each over its whole table, and their SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, html, jaccard, langid, linededup, pii, runs, simhash, tokencount, topk, warc
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("hit_items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern).drop("text")
    back = bpe.decode(ids, ranks, pattern)
    return back.select("doc_id", bpe.n_tokens(F.col("token_ids")).alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), every_pair=True).select("doc_id", "n_removed", "text")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures_of_pages(table(spark, sf_dir, "pages")))
    return found.select("record_id", "canonical", "outcome", "response_id", F.col("status").cast("long").alias("status"), warc.header_text(F.col("headers")).alias("headers"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "runs", "by_repeats", "by_markup")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.filter(base, lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"), "n_rejected")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(runs.with_repeated_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = [F.col(f"strongest.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.floor(1000 * F.col("strongest.length") / F.col("strongest.period")).cast("long")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, exponent.alias("exponent_milli"), F.sha2(runs.run_text(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_bpe, op3_line_dedup, op4_simhash, op5_warc_revisits, op6_topk, op7_token_counts, op8_html_text, op9_pii, op10_langid, op11_periodic_runs, op12_ngram_jaccard, op13_source_divergence)}

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

SQL = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS t(i)),
hits AS (SELECT DISTINCT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_warc_revisits": """
WITH c AS (SELECT page_id AS id, page_id % 4 = 3 AS revisit, page_id % 13 = 0 AND page_id % 4 <> 3 AS missing,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '//([^/]*)', 1)), '^.*@', ''), ':(80|443)?$', ''), '^www\\.', '') || '?a=' || (page_id % 3) || '&b=2' AS canonical,
    CASE WHEN page_id % 7 <> 0 THEN '"' || (page_id // 512) || '"' END AS tag, CASE WHEN page_id % 11 <> 0 THEN 'day ' || (page_id // 512) END AS day,
    octet_length(encode(html)) AS size FROM pages),
f AS (SELECT * FROM c WHERE NOT revisit AND NOT missing),
j AS (SELECT r.id, r.canonical, r.tag, r.day, f.id AS prior, f.tag AS ptag, f.day AS pday, f.size AS psize
  FROM (SELECT * FROM c WHERE revisit) r ASOF LEFT JOIN f ON r.canonical = f.canonical AND r.id > f.id),
o AS (SELECT *, CASE WHEN prior IS NULL THEN 'no_response' WHEN coalesce(tag = ptag, day = pday) THEN 'resolved'
  WHEN coalesce(tag = ptag, day = pday) IS NULL THEN 'unverified' ELSE 'mismatch' END AS outcome FROM j)
SELECT id AS record_id, canonical, outcome, CASE WHEN outcome = 'resolved' THEN prior END AS response_id,
  CAST(CASE WHEN outcome = 'resolved' THEN 200 END AS BIGINT) AS status,
  CASE WHEN outcome = 'resolved' THEN concat_ws(chr(10), 'content-length: ' || psize, 'content-type: text/html', 'date: t' || id,
    'etag: ' || coalesce('W/' || tag, ptag), 'last-modified: ' || coalesce(day, pday)) END AS headers
FROM o""",
    "op6_topk": """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op12_ngram_jaccard": """
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON a = x.r JOIN n y ON b = y.r WHERE 100 * o >= 80 * (x.n + y.n - o)),
c(r, root) USING KEY (r) AS (SELECT r, doc_id AS root FROM w
  UNION (SELECT e.b, min(c.root) AS root FROM c JOIN e ON c.r = e.a JOIN recurring.c AS old ON old.r = e.b WHERE c.root < old.root GROUP BY 1))
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, root AS component_id FROM w LEFT JOIN n USING (r) JOIN c USING (r)""",
    "op13_source_divergence": """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, CAST(sum(n) AS HUGEINT) AS total, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (g.total + l.v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // (l.total + l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200""",
}
