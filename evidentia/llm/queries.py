"""The numbered queries over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontamination, hard_negatives, media_ts, neardup, packing, sharding, suffix_dedup, token_counts, token_files, toxicity, url_rules, warc_zip
from .common import table, written

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
END_ID = 2


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = token_files.write_token_table(docs, public_tokenizers.path(BYTE_BPE), END_ID)
    return token_files.read_token_table(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, public_tokenizers.path(WORD_BPE), 4096, END_ID)
    return packing.pack(cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), 4096)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), tests AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), cut AS (
  SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM tests WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS win FROM cut
), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words
), spans AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM places, (SELECT DISTINCT n FROM windows) WHERE i + n - 1 <= len(w)
), found AS (
  SELECT doc_id, i, spans.n, item_id FROM spans JOIN windows USING (n, win)
), hits AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(*toxicity.training_sample(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    scored = toxicity.toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=85)


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM words WHERE len(w) > 0
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s FROM places
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)
), near AS MATERIALIZED (
  SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM words
  UNION
  SELECT reached.doc_id, near.v FROM reached JOIN near ON near.u = reached.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""

SHARD_LIMIT = 128 << 10


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.sharded(docs, "doc_id", "text", SHARD_LIMIT).select("doc_id", "n_bytes", "depth", "shard", "page", "shard_bytes")


OP6_SQL = f"""
WITH placed AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents
), nodes AS (
  SELECT depth, place >> (60 - depth) AS prefix, sum(n_bytes)::BIGINT AS bytes FROM placed, (SELECT unnest(range(0, 61))::INTEGER AS depth) GROUP BY ALL
), leaves AS (
  SELECT place, arg_min(prefix, depth) AS prefix, min(depth) AS depth, arg_min(bytes, depth) AS shard_bytes
  FROM (SELECT DISTINCT place FROM placed) JOIN nodes ON place >> (60 - depth) = prefix WHERE bytes <= {SHARD_LIMIT} OR depth = 60 GROUP BY place
)
SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, CASE WHEN shard_bytes > {SHARD_LIMIT} THEN 1 ELSE 0 END::BIGINT AS page, shard_bytes FROM placed JOIN leaves USING (place)
"""


def op7_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    padded = docs.withColumn("payload", F.expr("rpad(text, greatest(64, cast(ceil(n_bytes / 64.0) * 64 as int)), X'00')"))
    media, _ = written(media_ts.multiplexed(padded, "payload", ("doc_id", "n_bytes")), "media")
    read = media_ts.parsed(media, "media", ("doc_id", "n_bytes", "media"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        media_ts.feature().alias("feature"),
    )


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.encode("html", "UTF-8").alias("payload"))
    archives = warc_zip.write_archives(warc_zip.with_revisits(pages))
    return warc_zip.records_of(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), spelled AS (
  SELECT page_id, payload_bytes, array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1) FOR s IN [15, 10, 5, 0]], '') FOR v IN [('0x' || substr(h, 5 * k + 1, 5))::INTEGER FOR k IN range(0, 8)]], '') AS payload_digest FROM hashed
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM spelled
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM firsts
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = token_counts.token_counts(docs, public_tokenizers.path(BYTE_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS rules(host, path, verdict)")
    return url_rules.judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP10_SQL = r"""
WITH urls AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM urls
), rules(r_host, r_path, r_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT page_id, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversations.digests(conversations.repaired(damaged(rows)))
    return rows.select("conv_id").distinct().join(found, F.coalesce(rows["conv_id"].cast("string"), F.lit(" ")) == found["conversation"], "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """The rows as the query damages them, by a checksum of conversation and turn."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.select("turn", shown("conv_id").alias("conversation"), shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))
    return out.where("fault <> 0").select("conversation", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_")).drop("_")


OP11_SQL = r"""
WITH RECURSIVE shown AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS conversation, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations
), bytes AS (
  SELECT *, encode(conversation || ':' || coalesce(turn::VARCHAR, ' ')) AS k FROM shown
), checks(conversation, turn, role, text, k, i, crc) AS (
  SELECT conversation, turn, role, text, k, 0, 4294967295::BIGINT FROM bytes
  UNION ALL
  SELECT conversation, turn, role, text, k, i + 1, list_reduce([xor(crc, ('0x' || substr(hex(k), 2 * i + 1, 2))::BIGINT), 0, 1, 2, 3, 4, 5, 6, 7], lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
  FROM checks WHERE i < octet_length(k)
), faults AS (
  SELECT conversation, turn, role, text, xor(crc, 4294967295) % 20 AS fault FROM checks WHERE i = octet_length(k)
), damaged AS MATERIALIZED (
  SELECT conversation, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM faults WHERE fault <> 0
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conversation ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, row_number() OVER (PARTITION BY conversation, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS ending FROM damaged
), judged AS MATERIALIZED (
  SELECT *, ending = '' AS is_blank, ending <> '' AND nth > 1 AS is_copy, ending <> '' AND nth = 1 AND ending NOT IN ('.', '!', '?') AS is_cut,
    lag(left(role, 1)) OVER (PARTITION BY conversation ORDER BY i) AS before FROM placed
), counts AS (
  SELECT conversation, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_copy) AS duplicate, count(*) FILTER (is_cut) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM judged GROUP BY conversation
), arcs(state, put, next) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)
), keeps(state, initial, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), pads(state, i_cost, letters, lines, next) AS (
  SELECT s, 0, '', ''::VARCHAR, s FROM (VALUES (0), (1), (2), (3)) v(s)
  UNION ALL
  SELECT x.state, 5, 'I', x.put || ':' || chr(10), x.next FROM arcs x
  UNION ALL
  SELECT x.state, 10, 'II', x.put || ':' || chr(10) || y.put || ':' || chr(10), y.next FROM arcs x JOIN arcs y ON y.state = x.next
), eats AS MATERIALIZED (
  SELECT conversation, i, state, 2 AS cost, 'D' AS letter, '' AS line, state AS next FROM judged, (VALUES (0), (1), (2), (3)) v(state)
  UNION ALL
  SELECT conversation, i, state, CASE WHEN is_cut THEN 5 ELSE 0 END, 'K', role || ':' || text || chr(10), next FROM judged JOIN keeps ON left(role, 1) = initial WHERE NOT is_blank AND NOT is_copy
  UNION ALL
  SELECT conversation, i, state, 1 + CASE WHEN is_cut THEN 5 ELSE 0 END, 'R', put || ':' || text || chr(10), next FROM judged, arcs WHERE NOT is_blank AND NOT is_copy
), ways(conversation, i, state, cost, audit, body) AS (
  SELECT conversation, 0::BIGINT, 0, 0, '', '' FROM counts
  UNION ALL
  SELECT conversation, i, state, unnest(best).cost, unnest(best).audit, unnest(best).body FROM (
    SELECT w.conversation, w.i + 1 AS i, e.next AS state, [min(struct_pack(cost := w.cost + p.i_cost + e.cost, audit := w.audit || p.letters || e.letter, body := w.body || p.lines || e.line))] AS best
    FROM ways w JOIN pads p ON p.state = w.state JOIN eats e ON e.conversation = w.conversation AND e.i = w.i + 1 AND e.state = p.next GROUP BY ALL)
), ends AS (
  SELECT w.conversation, min(struct_pack(cost := w.cost + p.i_cost, audit := w.audit || p.letters, body := w.body || p.lines)) AS best
  FROM ways w JOIN counts c ON c.conversation = w.conversation AND w.i = c.n JOIN pads p ON p.state = w.state WHERE p.next IN (0, 3) GROUP BY w.conversation
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.body[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts ON counts.conversation = coalesce(conv_id::VARCHAR, ' ') LEFT JOIN ends USING (conversation)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = hard_negatives.usable(table(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("embedding"), label)
    return hard_negatives.hard_negatives(rows, F.col("id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id AS id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER near AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW near AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER near <= 3
"""


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_files, op2_packing, op3_decontamination, op4_toxicity, op5_neardup, op6_sharding, op7_media_ts, op8_warc_zip, op9_token_counts, op10_url_rules, op11_conversations, op12_hard_negatives, op13_suffix_dedup)
}
ORACLES: dict[str, str] = {"op3_decontamination": OP3_SQL, "op5_neardup": OP5_SQL, "op6_sharding": OP6_SQL, "op8_warc_zip": OP8_SQL, "op10_url_rules": OP10_SQL, "op11_conversations": OP11_SQL, "op12_hard_negatives": OP12_SQL}
