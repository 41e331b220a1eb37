"""One query for each operator, over its whole table, with the columns of its contract."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import byte_bpe, chat, decontamination, fingerprints, inner_products, language, lexical, licenses, near_copies, periodic, pii, quality
from . import token_counts as tokens
from .registry import ORACLES, QUERIES, query, table  # noqa: F401


def remainder(n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(-1))


@query("op2_token_counts")
def op2_token_counts(spark, sf):
    return tokens.token_counts(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_byte_bpe")
def op8_byte_bpe(spark, sf):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode_and_decode(table(spark, sf, "documents"), ranks))


SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"list_filter(regexp_split_to_array({LOWERED}, '{SEPARATORS}'), lambda w: w <> '')"

OP6_SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
win AS (
  SELECT item, array_to_string(w[i:i + 9], ' ') AS g, CAST(least(len(w), 10) AS BIGINT) AS n
  FROM item, unnest(range(1, greatest(1, len(w) - 9) + 1)) t(i) WHERE len(w) > 0
),
doc AS (SELECT doc_id, {WORDS} AS w FROM documents),
gram AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM doc, (SELECT DISTINCT n FROM win) l, unnest(range(1, CAST(len(w) AS BIGINT) - n + 2)) t(i)
),
hit AS (SELECT doc_id, i, gram.n, item FROM gram JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op6_benchmark_decontamination", OP6_SQL)
def op6_benchmark_decontamination(spark, sf):
    return decontamination.summary(decontamination.find_windows(table(spark, sf, "documents"), table(spark, sf, "benchmark")))


@query("op10_pii")
def op10_pii(spark, sf):
    return pii.summary(pii.find_spans(table(spark, sf, "documents")))


@query("op5_license_scan")
def op5_license_scan(spark, sf):
    return licenses.summary(table(spark, sf, "documents"))


@query("op7_fingerprints")
def op7_fingerprints(spark, sf):
    return fingerprints.passage_report(table(spark, sf, "documents"))


QUALITY_LIMIT = 0.7


@query("op3_quality_classifier")
def op3_quality_classifier(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality.train(docs, table(spark, sf, "labels").filter(remainder(4) != 2))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= QUALITY_LIMIT).cast("int").alias("predicted"))


@query("op9_language_id")
def op9_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    found = language.predict(docs, language.train(docs.filter(remainder(5) != 0)))
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")


OP4_SQL = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
),
gram AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ')) AS g
  FROM doc, unnest(range(1, greatest(1, len(w) - 4) + 1)) t(i) WHERE len(w) > 0
),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM gram x JOIN gram y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN size sa ON sa.doc_id = a JOIN size sb ON sb.doc_id = b WHERE 100 * c >= 75 * (sa.n + sb.n - c)
),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM r JOIN link l ON r.b = l.a) SELECT a, min(b) AS b FROM r GROUP BY a
)
SELECT doc.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc.doc_id, coalesce(b, doc.doc_id)) AS component_id
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN reach ON reach.a = doc.doc_id"""


@query("op4_ngram_jaccard_join", OP4_SQL)
def op4_ngram_jaccard_join(spark, sf):
    return near_copies.near_copies(table(spark, sf, "documents"))


@query("op1_chat_formatting")
def op1_chat_formatting(spark, sf):
    said = "</s>[INST] ok [/INST]"
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.format_conversations(given.unionByName(added), public_tokenizers.path("piece_bpe_32k.model")))


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf):
    return periodic.summary(periodic.find_runs(periodic.with_periodic_tails(table(spark, sf, "documents"))))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, len(v.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5"""


@query("op12_exact_top_k", OP12_SQL)
def op12_exact_top_k(spark, sf):
    return inner_products.top_products(table(spark, sf, "embeddings"), F.col("id") % 50 == 0)


OP13_SQL = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents
),
total AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(w)) AS BIGINT) AS nl FROM doc WHERE len(w) > 0),
tf AS MATERIALIZED (SELECT doc_id, len(w) AS n, t, count(*) AS tf FROM doc, unnest(w) u(t) GROUP BY ALL),
df AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, total GROUP BY t, nd),
asked AS (
  SELECT item_id, t, count(*) AS times
  FROM benchmark, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) u(t)
  WHERE t <> '' GROUP BY ALL
),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nl)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (t) JOIN df USING (t), total GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 20"""


@query("op13_ranked_search", OP13_SQL)
def op13_ranked_search(spark, sf):
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
