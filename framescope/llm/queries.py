"""The driver's queries over the operators of this package, with production parameters, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.llm import embeddings, filter_audit, language, licenses, lm, merkle, neardup, neighbours, packing, quality, sentencepiece, sharding, toxicity
from framescope.llm.common import fold, stage, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepiece.decode(sentencepiece.encode(table(spark, sf_dir, "documents"), model), model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language.train(*language.training_windows(docs.where(fold("doc_id", 5) != 0)))
    labelled = language.label_languages(docs, net)
    return labelled.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.lm_scores(table(spark, sf_dir, "documents"), train=fold("doc_id", 7) != 2, tune=fold("doc_id", 7) == 3)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.number_slots(sharding.assign_shards(sized, "doc_id", [1.0] * 40, grown_weight=1.0), "shard", ["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.col("base_starts")
    return found.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.array_join("expressions", "; ").alias("expressions"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn_lexicon(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    scored = toxicity.score_toxicity(docs, lexicon)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits", "weight", "n_words")


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9).select("vec_id", "n_links", "component_id", "kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    words = filter_audit.words_of(text)
    failures = {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
        "E": None,  # copies of a text with a smaller id
    }
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), failures)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = lambda text: [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    tampered = F.when(fold("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = table(spark, sf_dir, "documents").select("doc_id", "source", merkle.row_digest(fields(F.col("text"))).alias("leaf"), merkle.row_digest(fields(tampered)).alias("claimed"))
    proven = merkle.merkle_manifest(stage(leaves, "document-leaves"), "source", "doc_id", "leaf")
    told = proven.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"), merkle.fold_path(F.col("claimed"), F.col("path")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language": op2_language,
    "op3_lm": op3_lm,
    "op4_packing": op4_packing,
    "op5_sharding": op5_sharding,
    "op6_minhash": op6_minhash,
    "op7_licenses": op7_licenses,
    "op8_toxicity": op8_toxicity,
    "op9_embeddings": op9_embeddings,
    "op10_quality": op10_quality,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle": op12_merkle,
    "op13_neighbours": op13_neighbours,
}

#: Words and their distinct five-word shingles, all pairs that share one, and the least id reachable.
_OP6_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = d.doc_id LEFT JOIN sizes s USING (doc_id)
"""

#: All pairs by cosine in double precision, and the least id reachable.
_OP9_SQL = """
WITH RECURSIVE valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = e.vec_id
LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) n ON n.u = e.vec_id
"""

#: crc32 byte by byte over a table of 256 remainders; the shard with the greatest digest, as all weights are equal; slots by digest parts.
_OP5_SQL = """
WITH t AS (SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
b AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, encode(coalesce(text, '')) AS raw FROM documents),
d AS (
  SELECT doc_id, k, (octet_length(raw) + 16)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(raw), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32,
    list_transform(range(41), lambda s: ('0x' || md5(k || ':' || s)[1:13])::BIGINT) AS draws FROM b, t),
p AS (SELECT *, (list_position(draws[1:40], list_max(draws[1:40])) - 1)::INTEGER AS shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || md5(k || chr(31) || text_crc32)[1:8])::BIGINT % 64, doc_id, text_crc32) - 1 AS slot,
  CASE WHEN draws[41] > list_max(draws[1:40]) THEN 40 ELSE shard END::INTEGER AS grown_shard
FROM p
"""

#: Counts by part and mask of failures; every order and step looks at all masks.
_OP11_SQL = """
WITH RECURSIVE d AS (SELECT *, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT coalesce(d.lang, '') AS part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, mask),
o(o) AS (SELECT '' UNION ALL SELECT o || f FROM o, unnest(['A', 'B', 'C', 'D', 'E']) u(f) WHERE NOT contains(o, f)),
s AS (
  SELECT o AS filter_order, i::INTEGER AS step, o[i] AS f, (1 << (ascii(o[i]) - 65)) AS bit, coalesce(list_sum(list_transform(range(1, i), lambda j: 1 << (ascii(o[j]) - 65))), 0)::BIGINT AS before
  FROM o, range(1, 6) r(i) WHERE length(o) = 5),
r AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, f)
SELECT * EXCLUDE (f), sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM r
"""

#: Trees level by level, of each source and then of the sources; a row's siblings are its run's others at every level.
_OP12_SQL = """
WITH RECURSIVE tab AS (SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
d AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS crc FROM documents, tab),
f AS (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS told FROM d),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(told)) || ':' || told, '-')) AS claimed
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM f)),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
t(lev, source, pos, n, h) AS (
  SELECT 0, source, pos, n, leaf FROM p
  UNION ALL SELECT lev + 1, source, pos // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lev, source, pos // 3),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spos, count(*) OVER () AS sn FROM t WHERE n = 1),
u(lev, pos, n, h) AS (
  SELECT 0, spos, sn, subroot FROM s
  UNION ALL SELECT lev + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lev, pos // 3),
runs AS (
  SELECT 0 AS tree, lev, source, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM t WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT 1, lev, NULL, pos // 3, list(h ORDER BY pos) FROM u WHERE n > 1 GROUP BY ALL),
walk(doc_id, leaf, claimed, subroot, source, tree, lev, pos, left_to, said, folded, uid) AS (
  SELECT doc_id, leaf, claimed, subroot, p.source, 0, 0, pos, n, '', claimed, row_number() OVER () FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT w.doc_id, w.leaf, w.claimed, w.subroot, w.source, CASE WHEN w.left_to > 1 THEN w.tree ELSE 1 END, CASE WHEN w.left_to > 1 THEN w.lev + 1 ELSE 0 END,
    CASE WHEN w.left_to > 1 THEN w.pos // 3 ELSE s.spos END, CASE WHEN w.left_to > 1 THEN (w.left_to + 2) // 3 ELSE s.sn END,
    CASE WHEN w.left_to > 1 THEN w.said || array_to_string(hs[1:w.pos % 3], '') || array_to_string(hs[w.pos % 3 + 2:], '') ELSE w.said END,
    CASE WHEN w.left_to > 1 THEN sha256(array_to_string(hs[1:w.pos % 3], '') || w.folded || array_to_string(hs[w.pos % 3 + 2:], '')) ELSE w.folded END, w.uid
  FROM walk w JOIN s ON w.source IS NOT DISTINCT FROM s.source
  LEFT JOIN runs r ON r.tree = w.tree AND r.lev = w.lev AND r.run = w.pos // 3 AND w.left_to > 1 AND (w.tree = 1 OR r.source IS NOT DISTINCT FROM w.source)
  WHERE w.left_to > 1 OR w.tree = 0)
SELECT doc_id, leaf, subroot, h AS root, sha256(said) AS proof_sha256, folded AS folded_root, folded = h AS verified
FROM walk JOIN (SELECT h FROM u WHERE n = 1) ON true WHERE walk.tree = 1 AND walk.left_to = 1
"""

ORACLE_SQL: dict[str, str] = {
    "op5_sharding": _OP5_SQL,
    "op9_embeddings": _OP9_SQL,
    "op6_minhash": _OP6_SQL,
    "op11_filter_audit": _OP11_SQL,
    "op12_merkle": _OP12_SQL,
}
