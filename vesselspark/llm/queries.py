"""The queries of this package, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselspark.llm import ann, conversations, decontaminate, fim, langid, packing, pieces, pii, quality, substrings, urlrules, vector_dedup
from vesselspark.llm.common import load
from vesselspark.llm.simhash import simhash_components


def remainder(by: int) -> Column:
    """The fold a document lies in: crc32 of its id as text, modulo ``by``."""
    return F.crc32(F.col("doc_id").cast("string")) % by


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = quality.train(docs, load(spark, sf_dir, "labels").where(remainder(5) != 0))
    scored = quality.score_documents(docs, model).withColumnRenamed("id", "doc_id")
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int")
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", predicted.alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(load(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the digest are of the base spans; ``spans`` has those that the trees select as well."""
    docs = load(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(load(spark, sf_dir, "documents"), *paths)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = load(spark, sf_dir, "documents")
    model = langid.train(docs.where(remainder(4) != 2), public_tokenizers.path("piece_bpe_32k.model"))
    found = langid.identify(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urlrules.judge(load(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


OP7_SQL = r"""
WITH parsed AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' END AS rule
  FROM parsed)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pieces.round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(F.col("id").alias("doc_id"), "n_ids", "ids_crc32", "score", "exact")


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_components(load(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(load(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fim.restored(F.col("output"), F.col("form"))
    digest = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (back, "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, load(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed, (F.col("n_hit") > 0).alias("contaminated"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(load(spark, sf_dir, "conversations"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS s FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d)),
dup AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + k AS i FROM win JOIN dup USING (s), (SELECT unnest(generate_series(0, 34)) AS k)),
word AS (SELECT r, i, w[i] AS x FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d)),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON c.vec_id = k.a
"""
OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS p, ('0x' || h[25:32])::BIGINT % 100 AS q FROM d),
f AS (SELECT *, least(x, y) AS a, greatest(x, y) - least(x, y) AS m,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p >= 90 THEN 'plain' WHEN q < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
s AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, m) AS middle, substring(t, a + m + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM s
"""
OP12_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
own AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM win))),
hit AS (SELECT r, i, k, item_id FROM own JOIN win USING (k, s)),
n AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS i FROM hit) GROUP BY r),
ids AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS t FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items, sha256(coalesce(ids.t, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN ids USING (r)
"""
#: crc32 is computed from its table of 256 steps, made from its polynomial.
OP13_SQL = """
WITH tab AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))) AS steps),
t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || sha256(text))) AS xs FROM t GROUP BY c),
drawn AS (SELECT c, xs, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda z: ord(z)::BIGINT)),
  lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1]))) % 6 AS h FROM own, tab),
made AS (SELECT d.c, list_concat(coalesce(b.xs[1:h], []), d.xs[h + 1:]) AS xs FROM drawn d LEFT JOIN own b ON b.c = d.c - d.c % 100),
path AS (SELECT c, d, xs[1:d] AS p, d = len(xs) AS ends FROM (SELECT c, xs, unnest(generate_series(0, len(xs))) AS d FROM made)),
node AS (SELECT d, p, min(c) AS c, count(*) AS n, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends) AS ids FROM path GROUP BY d, p),
kids AS (SELECT p[1 : d - 1] AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY p[1 : d - 1]),
counted AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids USING (p)),
sums AS (SELECT a AS p, count(*) FILTER (k = 0) AS leaves, sum(saved) AS saved
  FROM (SELECT k, CASE WHEN d > 0 THEN (n - 1) * length(p[d].text) ELSE 0 END AS saved, p[1 : unnest(generate_series(0, d))] AS a FROM counted) GROUP BY a)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, up.c AS parent_conv_id, f.n AS n_convs, f.k AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(f.ids, '')) AS ends_sha256
FROM counted f JOIN sums USING (p) LEFT JOIN node up ON up.d = f.d - 1 AND up.p = f.p[1 : f.d - 1]
"""


QUERIES = {f.__name__: f for f in (op1_quality, op2_simhash, op3_pii, op4_packing, op5_language, op6_neighbours, op7_url_rules, op8_substrings, op9_pieces, op10_vector_dedup, op11_fim, op12_decontamination, op13_prefix_trie)}
ORACLE_SQL: dict[str, str] = {"op7_url_rules": OP7_SQL, "op8_substrings": OP8_SQL, "op10_vector_dedup": OP10_SQL, "op11_fim": OP11_SQL, "op12_decontamination": OP12_SQL, "op13_prefix_trie": OP13_SQL}
