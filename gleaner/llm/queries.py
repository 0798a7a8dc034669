"""Registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import chat, exact, minhash, mixing, negatives, neighbours, packing, quality, sharding, simhash, suffixes, warc, whitening


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def op1_minhash(spark: SparkSession, root: str) -> DataFrame:
    """Near duplicates over shingles of four words, linked from 0.8 on."""
    return minhash.groups(_table(spark, root, "documents"), words=4, percent=80).drop("mark")


def op2_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth one."""
    return neighbours.search(_table(spark, root, "embeddings"), every=100, k=10)


def op3_suffixes(spark: SparkSession, root: str) -> DataFrame:
    """Documents without the bytes of 200-byte strings that occur again."""
    return suffixes.remove_repeats(_table(spark, root, "documents"))


def op4_sharding(spark: SparkSession, root: str) -> DataFrame:
    """Documents in eight shards that each hold the mixture of sources."""
    return sharding.shards(_table(spark, root, "documents"))


def op5_mixing(spark: SparkSession, root: str) -> DataFrame:
    """How often the mix takes each document."""
    return mixing.mix(_table(spark, root, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_quality(spark: SparkSession, root: str) -> DataFrame:
    """Quality of every document by a model of the labelled ones."""
    return quality.score(_table(spark, root, "documents"), _table(spark, root, "labels")).drop("mark")


#: Tools of the traffic that :func:`tool_traffic` derives.
TOOLS = {
    "lookup": {"properties": {"text": {"type": "string"}, "words": {"type": "integer"}, "after": {"type": "string"}}, "required": ["text", "words"]},
    "count": {"properties": {"words": {"type": "integer"}}, "required": ["words"], "additionalProperties": False},
}


def tool_traffic(chats: DataFrame) -> DataFrame:
    """The conversations with a tool call before every assistant turn, and its result.

    Turns are spread by ten. Results of some calls stand before them, some are
    missing; some calls lack an argument, have a wrong type or an unknown tool;
    those of every fourth turn refer to the call two turns before.
    """
    words = F.size(F.split("text", " "))
    draw = F.crc32(F.concat_ws("-", "conv_id", "turn", "text").cast("binary"))
    name = F.when(draw % 13 == 0, "guess").when(draw % 2 == 0, "count").otherwise("lookup")
    call = F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn"))
    after = F.when(F.col("turn") % 4 == 3, F.create_map(F.lit("$ref"), F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn") - 2)))
    number = F.when(draw % 7 != 0, words)
    asked = F.to_json(F.struct(F.array(F.struct(
        call.alias("id"), name.alias("name"),
        F.struct(F.when(name != "count", F.col("text")).alias("text"), number.alias("words"), F.when(name != "count", after).alias("after")).alias("arguments"),
    )).alias("tool_calls")))
    given = F.to_json(F.struct(call.alias("tool_call_id"), words.cast("string").alias("content")))
    turn = F.col("turn") * 10
    said = chats.filter("role = 'assistant'")
    return (
        chats.select("conv_id", turn.alias("turn"), "role", "text")
        .unionByName(said.select("conv_id", (turn - 5).alias("turn"), "role", asked.alias("text")))
        .unionByName(
            said.filter(draw % 11 != 0).select("conv_id", (turn - F.when(draw % 5 == 0, 6).otherwise(4)).alias("turn"), F.lit("tool").alias("role"), given.alias("text"))
        )
    )


def op7_chat(spark: SparkSession, root: str) -> DataFrame:
    """Conversations with tool traffic as ordered, validated events."""
    return chat.format_chats(tool_traffic(_table(spark, root, "conversations")), TOOLS)


def op8_warc(spark: SparkSession, root: str) -> DataFrame:
    """Pages written as archives and read back."""
    return warc.round_trip(_table(spark, root, "pages"))


def op9_packing(spark: SparkSession, root: str) -> DataFrame:
    """Documents as pieces in sequences of 2048 tokens."""
    return packing.pack(_table(spark, root, "documents")).drop("mark")


def op10_exact(spark: SparkSession, root: str) -> DataFrame:
    """Groups of equal documents and the row of each that stays."""
    return exact.copies(_table(spark, root, "documents")).drop("mark")


def op11_negatives(spark: SparkSession, root: str) -> DataFrame:
    """Hard negatives of every fiftieth vector."""
    return negatives.mine(_table(spark, root, "embeddings"))


def op12_whitening(spark: SparkSession, root: str) -> DataFrame:
    """Every vector whitened by the covariance of the distinct ones."""
    return whitening.whiten(_table(spark, root, "embeddings"))


def op13_simhash(spark: SparkSession, root: str) -> DataFrame:
    """Near duplicates by fingerprints over shingles of three words, linked up to three bits."""
    return simhash.groups(_table(spark, root, "documents")).drop("mark")


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash, op2_neighbours, op3_suffixes, op4_sharding, op5_mixing, op6_quality, op7_chat, op8_warc, op9_packing, op10_exact,
        op11_negatives, op12_whitening, op13_simhash,
    )
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_minhash": rf"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]) END AS s
  FROM split),
sized AS MATERIALIZED (SELECT doc_id, len(s)::BIGINT AS n FROM shingled),
one AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM shingled),
shared AS MATERIALIZED (SELECT x FROM one GROUP BY x HAVING count(*) > 1),
used AS MATERIALIZED (SELECT doc_id, x FROM one JOIN shared USING (x)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared_n FROM used a JOIN used b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sized p ON p.doc_id = a JOIN sized q ON q.doc_id = b WHERE 100 * shared_n >= 80 * (p.n + q.n - shared_n)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS node, doc_id AS other FROM sized
  UNION
  SELECT r.node, e.b FROM reached r JOIN edges e ON e.a = r.other)
SELECT z.doc_id, z.n AS n_shingles, min(r.other) AS component_id, z.doc_id = min(r.other) AS kept
FROM sized z JOIN reached r ON r.node = z.doc_id GROUP BY z.doc_id, z.n
""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages),
d AS (SELECT *, sha1(h) AS hex FROM p),
b AS (SELECT *, array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31) + 1, 1)
    FOR i IN range(32)], '') AS payload_digest FROM d)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM b
""",
    "op3_suffixes": """
WITH coded AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS w FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 199)) AS i FROM coded)),
often AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
flagged AS (SELECT doc_id, i FROM windows JOIN often USING (w)),
cut AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS fresh FROM flagged),
runs AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM cut),
spans AS MATERIALIZED (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY 1, 2),
ends AS (
  SELECT doc_id, a, b FROM spans
  UNION ALL SELECT doc_id, length(h) // 2, NULL FROM coded),
between_spans AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b NULLS LAST), 0) AS from_ FROM ends),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY from_) AS k FROM between_spans JOIN coded USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM coded JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY 1) USING (doc_id)
""",
    "op4_sharding": """
WITH steps AS (SELECT [list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) FOR i IN range(256)] AS step),
coded AS (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM documents),
rows AS MATERIALIZED (
  SELECT doc_id, (length(h) // 2 + 1)::BIGINT AS size, coalesce('s' || source, 'z') AS stratum, md5('shards:' || coalesce(doc_id::VARCHAR, '')) AS draw,
    xor(list_reduce(
      list_concat([4294967295::BIGINT], [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(length(h) // 2)]),
      lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM coded, steps),
spread AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY draw, doc_id, text_crc32, size) - 0.5::DOUBLE)
    / count(*) OVER (PARTITION BY stratum) AS part FROM rows),
placed AS (
  SELECT *, row_number() OVER (ORDER BY part, stratum, draw, doc_id, text_crc32, size) - 1 AS g, count(*) OVER () AS n FROM spread)
SELECT doc_id, size, text_crc32, 'rows' AS law, (g * 8 // n)::INT AS shard, (g - ((g * 8 // n) * n + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed
""",
    "op5_mixing": r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('0' || source, '1') AS stratum,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents),
sized AS (SELECT stratum, sum(size)::BIGINT AS source_size FROM rows GROUP BY 1),
weighed AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY stratum) - 1) % 3 AS weight FROM sized),
steps AS (
  SELECT 0 AS step, (SELECT sum(source_size) / sum(weight) FROM weighed) AS factor
  UNION ALL
  SELECT s.step + 1, (
    SELECT (sum(source_size) - coalesce(sum(source_size * 3) FILTER (source_size * 3 <= weight * s.factor), 0))
      / nullif(sum(weight) FILTER (source_size * 3 > weight * s.factor), 0) FROM weighed)
  FROM steps s WHERE s.step < 30 AND s.factor IS NOT NULL),
factor AS (SELECT factor FROM steps WHERE factor IS NOT NULL ORDER BY step DESC LIMIT 1),
aims AS (SELECT stratum, source_size, least(source_size * 3.0, weight * coalesce((SELECT factor FROM factor), 0))::DOUBLE AS target FROM weighed),
placed AS (
  SELECT r.doc_id, r.size, a.source_size, a.target,
    row_number() OVER (PARTITION BY r.stratum ORDER BY r.size, r.draw) - 1 AS k,
    CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS each,
    ('0x' || substr(md5('mix:' || r.stratum), 1, 3))::INT / 4096 + 1 / 8192 AS shift
  FROM rows r JOIN aims a USING (stratum)),
taken AS (SELECT *, (floor((k + 1) * each + shift) - floor(k * each + shift))::BIGINT AS copies FROM placed)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM taken
""",
    "op10_exact": r"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
""",
    "op11_negatives": """
WITH v AS MATERIALIZED (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * c::DOUBLE) FOR c IN embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INT AS rank
  FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""",
}
