"""The registered queries of this folder and the SQL that checks them, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import ann, chat, decontam, jaccard, langid, linededup, packing, resampling, sharding, substrings, toxicity, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CONTROL = "\\### Assistant: </turn> ok"

CHAT_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), e AS (
  SELECT *, regexp_replace(text, '<(\\\\*/?turn)', '<\\\\\\1', 'g') AS esc FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(6 + length(role) + 1 + length(esc) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op1_chat_formatting", CHAT_SQL)
def chat_formatting(spark, sf_dir):
    """All conversations and one made of control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text")
    )
    return chat.chat_report(turns.union(extra))


@query("op10_rendezvous_sharding")
def rendezvous_sharding(spark, sf_dir):
    """Every document in one of 8 equal shards, and where it would be with a ninth."""
    return sharding.shard_report(table(spark, sf_dir, "documents"), 8)


@query("op9_toxicity")
def toxicity_scores(spark, sf_dir):
    """Every document's toxicity, learned from the labels outside the held-out fold."""
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_language_id")
def language_id(spark, sf_dir):
    """Every document's language, learned from the texts outside the held-out fold."""
    return langid.language_report(table(spark, sf_dir, "documents"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
l AS (SELECT html, max(page_id) AS last FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN p.page_id < l.last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < l.last THEN l.last END AS refers_to
FROM p LEFT JOIN l USING (html)
"""


@query("op4_warc_bundles", WARC_SQL)
def warc_bundles(spark, sf_dir):
    """All pages written as WARC records to seekable bundles and read back from them."""
    return warc.archive_report(table(spark, sf_dir, "pages"))


@query("op2_packing")
def packing_report(spark, sf_dir):
    """All documents as token sequences of at most 2048."""
    return packing.packing_report(table(spark, sf_dir, "documents"))


@query("op8_substring_dedup")
def substring_dedup(spark, sf_dir):
    """All documents without the passages of 35 words and more that stand in two places."""
    return substrings.substring_report(table(spark, sf_dir, "documents"))


@query("op5_ngram_jaccard_join")
def ngram_jaccard_join(spark, sf_dir):
    """Every document's shingles and the component of its links."""
    return jaccard.joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op6_benchmark_decontamination")
def benchmark_decontamination(spark, sf_dir):
    """Every document that holds a benchmark item, with the window that comes nearest to it."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


@query("op7_nearest_neighbours")
def nearest_neighbours(spark, sf_dir):
    """The 20 nearest rows of every 20th embedding."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 20, 20)


LINES_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), l AS (
  SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 2
), m AS (
  SELECT k.*, s.key IS NOT NULL AND doc_id IS DISTINCT FROM first AS gone FROM k LEFT JOIN s USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


@query("op11_line_dedup", LINES_SQL)
def line_dedup(spark, sf_dir):
    """All documents without the lines that a document with a smaller doc_id holds."""
    return linededup.line_report(table(spark, sf_dir, "documents"))


#: CRC-32 as a fold over the bytes of a feature, the table made by eight steps of the polynomial.
RESAMPLING_SQL = """
WITH tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b::BIGINT], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t
), f AS (
  SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), w AS (
  SELECT side, row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM f
), u AS (
  SELECT r, side, unnest(words) AS word FROM w
), x AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM u)
), c AS (
  SELECT word, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
      list_transform(range(length(h) // 2), lambda i: ((instr('0123456789ABCDEF', substr(h, (2 * i + 1)::BIGINT, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, (2 * i + 2)::BIGINT, 1)) - 1)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 10000 AS bucket
  FROM x, tab
), n AS (
  SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM u JOIN c USING (word) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
  FROM n, (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM n)
), d AS (
  SELECT w.r, any_value(doc_id) AS doc_id, any_value(len(words)) AS n_features, coalesce(sum(gain), 0)::BIGINT AS weight
  FROM w LEFT JOIN u USING (r) LEFT JOIN c USING (word) LEFT JOIN g USING (bucket) WHERE w.side = 'd' GROUP BY w.r
), e AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d
), o AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER () // 100 AS most FROM e WHERE n_features >= 20
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM e LEFT JOIN o USING (r)
"""


@query("op12_importance_resampling", RESAMPLING_SQL)
def importance_resampling(spark, sf_dir):
    """Every document's weight towards the benchmark and its place in the draw."""
    return resampling.resampling_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_embedding_whitening")
def embedding_whitening(spark, sf_dir):
    """The first eight whitened components of every usable embedding."""
    return whitening.whitening_report(table(spark, sf_dir, "embeddings"))
