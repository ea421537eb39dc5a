"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfloor.llm import collocations, fingerprints, language, merkle, mixing, near_copies, near_vectors, pieces, repeats, secret_scans, token_files, toxicity, warc
from watchfloor.llm.common import crc32_of_id

# zlib's CRC-32 of a decimal doc_id: the remainder by the public polynomial, a bit at a time.
CRC32_SQL = """xor(list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_of_id(F.col("doc_id")) % 4 == 2
    model = language.train(docs, usable=~held_out)
    found = language.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "family")


@query
def op2_fingerprints(spark, sf_dir):
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


@query
def op3_secrets(spark, sf_dir):
    return secret_scans.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op6_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("row")


@query
def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_of_id(F.col("doc_id")) % 5 == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op8_pieces(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"), check=True)


@query
def op9_warc(spark, sf_dir):
    return warc.archived(spark, table(spark, sf_dir, "pages")).drop("payload")


@query
def op4_near_vectors(spark, sf_dir):
    return near_vectors.near_vector_groups(table(spark, sf_dir, "embeddings"))


@query
def op5_near_copies(spark, sf_dir):
    return near_copies.near_copy_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


@query
def op10_repeats(spark, sf_dir):
    rows = repeats.without_repeats(table(spark, sf_dir, "documents"), keep="none")
    # What is left as text; a character cut in two shows as the replacement mark.
    return rows.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept", "spans")


@query
def op11_collocations(spark, sf_dir):
    return collocations.phrases(table(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
counts AS (
  SELECT lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, count(*) AS f
  FROM places, (VALUES (1), (2), (3), (4)) v(size) WHERE i + size - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang),
found AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE size > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r,
         CAST(CAST(c.a AS HUGEINT) * 2000000 // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM found) c
  JOIN counts l ON l.lang = c.lang AND l.size = k AND l.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
  JOIN counts r ON r.lang = c.lang AND r.size = c.size - k AND r.phrase = array_to_string(list_slice(c.w, k + 1, c.size), ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(list_slice(w, i, i + short - 1), ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, size - short + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS short FROM found))
  GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, score
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE longer IS NULL OR CAST(longer AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80)
JOIN totals USING (lang) WHERE rank <= 2000
"""


@query
def op12_token_files(spark, sf_dir):
    import public_tokenizers

    read = token_files.round_trip(spark, table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op13_merkle(spark, sf_dir):
    tampered = crc32_of_id(F.col("doc_id")) % 2 == 0
    seen = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle.verified(table(spark, sf_dir, "documents"), seen={"text": seen})
    proof = F.sha2(merkle.proof_text(F.col("proof")).cast("binary"), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


ORACLES["op13_merkle"] = r"""
WITH RECURSIVE
leaves AS (
  SELECT doc_id, source,
         sha256(concat(pre, coalesce(octet_length(encode(text)) || ':' || text, '-'))) AS leaf,
         sha256(concat(pre, coalesce(octet_length(encode(seen)) || ':' || seen, '-'))) AS seen,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM (
    SELECT doc_id, source, text, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS seen,
           concat(coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'),
                  coalesce(octet_length(encode(source)) || ':' || source, '-'),
                  coalesce(octet_length(encode(lang)) || ':' || lang, '-'),
                  coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS pre
    FROM (SELECT *, CRC32_OF_ID AS crc FROM documents))),
levels AS (
  SELECT source, 0 AS level, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT source, level + 1, idx // 3, CAST(ceil(any_value(n) / 3.0) AS BIGINT), sha256(string_agg(h, '' ORDER BY idx))
  FROM levels WHERE n > 1 GROUP BY source, level, idx // 3),
subroots AS (
  SELECT source, level AS height, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM levels WHERE n = 1),
upper AS (
  SELECT 0 AS level, idx, n, h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, CAST(ceil(any_value(n) / 3.0) AS BIGINT), sha256(string_agg(h, '' ORDER BY idx))
  FROM upper WHERE n > 1 GROUP BY level, idx // 3),
top AS (SELECT h AS root FROM upper WHERE n = 1),
walk AS (
  SELECT doc_id, source, false AS above, 0 AS level, idx, n, seen AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, source, above, level, idx, n, h, proof FROM (
    SELECT w.doc_id, w.source, w.above, w.level + 1 AS level, w.idx // 3 AS idx, CAST(ceil(w.n / 3.0) AS BIGINT) AS n,
           sha256(concat(coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx < w.idx), ''), w.h,
                         coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx > w.idx), ''))) AS h,
           concat(w.proof, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx <> w.idx), '')) AS proof
    FROM walk w JOIN (SELECT source, false AS above, level, idx, h FROM levels
                      UNION ALL SELECT NULL, true, level, idx, h FROM upper) s
      ON s.above = w.above AND s.level = w.level AND s.idx // 3 = w.idx // 3 AND (w.above OR s.source IS NOT DISTINCT FROM w.source)
    WHERE w.n > 1 GROUP BY w.doc_id, w.source, w.above, w.level, w.idx, w.n, w.h, w.proof
    UNION ALL
    SELECT w.doc_id, w.source, true, 0, r.idx, r.n, w.h, w.proof
    FROM walk w JOIN subroots r ON r.source IS NOT DISTINCT FROM w.source WHERE w.n = 1 AND NOT w.above))
SELECT l.doc_id, l.leaf, r.h AS subroot, top.root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = top.root AS verified
FROM walk w JOIN leaves l ON l.doc_id = w.doc_id JOIN subroots r ON r.source IS NOT DISTINCT FROM w.source, top
WHERE w.above AND w.n = 1
""".replace("CRC32_OF_ID", CRC32_SQL)

ORACLES["op6_mixing"] = r"""
WITH sizes AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source) s),
capped AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM ranked),
levels AS (
  SELECT *, (1.5 * CAST(total AS DOUBLE) - CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rank
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rank
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM capped),
targets AS (
  SELECT source, source_size, CAST(coalesce(least(CAST(cap AS DOUBLE), weight * (SELECT max(level) FROM levels WHERE level * weight <= cap)),
         CAST(cap AS DOUBLE)) AS DOUBLE) AS target
  FROM levels),
queue AS (
  SELECT s.doc_id, s.size, s.key, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sent
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
departures AS (
  SELECT q.doc_id, q.size, q.key, turn, CAST(sent + turn * source_size AS DOUBLE) / target AS time
  FROM queue q, (VALUES (0), (1)) v(turn) WHERE size > 0 AND target > 0),
mix AS (
  SELECT doc_id, size, key,
         sum(size) OVER (ORDER BY time, turn, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM departures),
given AS (
  SELECT doc_id, sum(greatest(0, least(size, (SELECT CAST(floor(1.5 * sum(size)) AS BIGINT) FROM sizes) - (upto - size)))) AS taken
  FROM mix GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken
FROM queue q LEFT JOIN given g ON q.doc_id = g.doc_id
"""
