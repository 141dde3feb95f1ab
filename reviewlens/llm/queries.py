"""The registered queries of the corpus operators: (spark, sf_dir) ->
DataFrame over the whole ``documents`` table, and the SQL of those that SQL
can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, conversation_trie, divergence, exact_dedup, language, licenses, line_dedup, merkle, mixing,
               parity_join, secrets, simhash, toxicity)
from .common import text_or_empty

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bpe_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    """(ranks, pattern) of the installed public vocabulary."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe_vocabulary()
    docs = documents(spark, sf_dir).select("doc_id", bpe.round_trip(F.col("text"), *vocabulary).alias("r"))
    return docs.select("doc_id", F.size("r.ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("r.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2(F.col("r.data"), 256).alias("decoded_sha256"))


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op3_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS kept, h AS text_sha256
FROM d
"""


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    index = line_dedup.build_index(docs)
    return docs.select("doc_id", line_dedup.drop_lines(F.col("text"), index).alias("r")).select(
        "doc_id", "r.n_lines", "r.n_dropped", F.sha2(F.encode(F.col("r.text"), "UTF-8"), 256).alias("kept_sha256"))


ORACLES["op10_line_dedup"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (
  SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM docs),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
marked AS (SELECT keyed.*, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often ON keyed.k = often.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language.learn(docs.filter(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), language.identify(F.col("text"), model).alias("r")).select(
        "doc_id", "held_out", F.col("r.lang").alias("lang_pred"), "r.score")


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(documents(spark, sf_dir), shingle=4, max_bits=4).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.learn(docs, labels.filter(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.compare_edits(merkle.with_next(documents(spark, sf_dir)))
    return rows.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       "fingerprint", "edited_fingerprint", "near_edited", "near_next",
                       F.array_join("edits", ",").alias("edits"))


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.find_secrets(documents(spark, sf_dir))
    counts = [F.size(secrets.of_kind(F.col("base"), k)).cast("long").alias(f"n_{name}")
              for k, (name, *_) in enumerate(secrets.BASE)]
    return rows.select(F.col("id").alias("doc_id"), *counts,
                       F.sha2(secrets.shown(F.col("base")), 256).alias("base_sha256"),
                       secrets.shown(F.col("spans")).alias("spans"))


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan_licenses(documents(spark, sf_dir)).withColumn("places", F.flatten("base"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"),
                       F.array_min("places").cast("long").alias("first_word"),
                       F.array_max("places").cast("long").alias("last_word"),
                       F.array_join("base_labels", ",").alias("base_labels"),
                       F.array_join("labels", ",").alias("labels"), "score")


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir), min_docs=3, top_terms=200)


ORACLES["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_c FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
c AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(lang_c) AS n FROM kept GROUP BY 1),
gn AS (SELECT g.lang, g.source, coalesce((SELECT sum(c.c) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n
       FROM g),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(c.c, 0) AS c,
             (1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (gn.n + v.v))::HUGEINT AS p,
             (1 + 1000000000::HUGEINT * (kept.lang_c + 1) // (v.n + v.v))::HUGEINT AS q
      FROM gn JOIN v USING (lang) JOIN kept USING (lang)
      LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
         FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
           FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query
def op12_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_join(documents(spark, sf_dir), shingle=4, num=85, den=100).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLES["op12_parity_join"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END AS s FROM d),
n AS (SELECT r, doc_id, len(s) AS n FROM s),
e AS (SELECT r, unnest(s) AS x FROM s),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n na ON na.r = c.a JOIN n nb ON nb.r = c.b
      WHERE 100 * k >= 85 * (na.n + nb.n - k)),
reach AS (SELECT r AS a, r AS b FROM n UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(m.doc_id) AS component_id
FROM reach JOIN n ON n.r = reach.a JOIN n m ON m.r = reach.b GROUP BY n.r, n.doc_id, n.n
"""


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLES["op13_conversation_trie"] = r"""
WITH t AS (
  SELECT conv_id::BIGINT AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 5 AS b, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
           lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0],
                                    lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 9 AS h
  FROM (SELECT DISTINCT c FROM t)),
k AS (SELECT convs.*, least(h, (SELECT count(*) FROM t WHERE t.c = convs.b)) AS kept FROM convs),
r AS (SELECT k.c, t.pos AS d, t.role, t.text FROM k JOIN t ON t.c = k.b AND t.pos <= k.kept
      UNION ALL SELECT k.c, k.kept + t.pos - k.h, t.role, t.text FROM k JOIN t ON t.c = k.c AND t.pos > k.h),
p AS (SELECT c, d, octet_length(encode(text)) AS bytes,
             sha256(string_agg(octet_length(encode(role)) || ':' || role || octet_length(encode(text)) || ':' || text, '')
                    OVER (PARTITION BY c ORDER BY d)) AS key FROM r),
m AS (SELECT c, 0 AS d, 0 AS bytes, '' AS key, NULL AS up FROM convs
      UNION ALL SELECT c, d, bytes, key, coalesce(lag(key) OVER (PARTITION BY c ORDER BY d), '') FROM p),
n AS (SELECT key, min(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(up) AS up,
             (count(*) - 1) * any_value(bytes) AS own FROM m GROUP BY key),
born AS (SELECT up, count(*) AS k FROM n WHERE up IS NOT NULL GROUP BY up),
leaf AS (SELECT n.*, coalesce(born.k, 0) AS n_children FROM n LEFT JOIN born ON born.up = n.key),
pairs AS (SELECT DISTINCT a.key AS top, b.key AS low FROM m a JOIN m b ON a.c = b.c AND a.d <= b.d),
sums AS (SELECT top, sum((n_children = 0)::BIGINT) AS n_leaves, sum(own) AS saved
         FROM pairs JOIN leaf ON leaf.key = low GROUP BY top),
last AS (SELECT c, arg_max(key, d) AS key FROM m GROUP BY c),
ends AS (SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS s FROM last GROUP BY key)
SELECT leaf.conv_id, leaf.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, leaf.n_convs, leaf.n_children,
       sums.n_leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens,
       coalesce(ends.s, sha256('')) AS ends_sha256
FROM leaf JOIN sums ON sums.top = leaf.key LEFT JOIN n u ON u.key = leaf.up LEFT JOIN ends ON ends.key = leaf.key
"""
