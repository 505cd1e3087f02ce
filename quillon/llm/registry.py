"""The queries opN_<name> over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import chat, decontamination, divergence, language, manifest, neighbours, packing, quality, sharding, simhash, sketches, token_planes, urls
from quillon.plans.staging import spread


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, over all cores even where they are one small file."""
    return spread(table(spark, sf_dir, "documents"))


#: (host, path, verdict)
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def url_rules(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, verdict)")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages"), url_rules(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op6_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, "virtual_slot", "map_version")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.beside_edited(table(spark, sf_dir, "documents"))


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_planes.write_planes(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return token_planes.read_planes(spark, shards)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.classify(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=100)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verify_documents(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_virtual_slot_sharding": op6_virtual_slot_sharding,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_document_fingerprints": op8_document_fingerprints,
        "op9_token_planes": op9_token_planes,
        "op10_language_id": op10_language_id,
        "op11_source_divergence": op11_source_divergence,
        "op12_nearest_neighbours": op12_nearest_neighbours,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

OP1_SQL = rf"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULES_SQL}),
urls AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fits AS (
  SELECT n, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC) AS k
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM urls LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
"""

OP7_SQL = """
WITH placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n_turns, role, text
  FROM conversations),
prefixes AS (
  SELECT conv_id, pos, n_turns,
         string_agg(coalesce(length(role)::varchar, '-') || ':' || coalesce(length(text)::varchar, '-') || ':' || coalesce(role, '') || coalesce(text, ''), '')
           OVER (PARTITION BY conv_id ORDER BY pos) AS upto
  FROM placed),
ends AS (
  SELECT n_turns, upto, min(conv_id) AS conv_id, count(*) AS copies FROM prefixes WHERE pos = n_turns GROUP BY ALL),
kept AS (
  SELECT * FROM ends WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.pos < p.n_turns AND p.pos = ends.n_turns AND p.upto = ends.upto))
SELECT k.conv_id, ((p.pos - 1) // 1024)::int AS part, first(p.n_turns) AS n_turns, first(k.copies) AS copies,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY p.pos) AS text
FROM kept k JOIN placed p ON p.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY ALL
"""


OP11_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM words),
held AS (SELECT n, lang, source, unnest(terms) AS term FROM words),
vocabulary AS (SELECT lang, term FROM held GROUP BY ALL HAVING count(DISTINCT n) >= 10),
v AS (SELECT lang, count(*) AS v FROM vocabulary GROUP BY ALL),
cells AS (
  SELECT lang, source, term, coalesce(c, 0)::HUGEINT AS c
  FROM groups JOIN vocabulary USING (lang)
  LEFT JOIN (SELECT lang, source, term, count(*) AS c FROM held GROUP BY ALL) USING (lang, source, term)),
whole AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM cells GROUP BY ALL),
p AS (SELECT lang, source, term, c, 1 + (1000000000 * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p FROM cells JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000 * (c + 2)) // (sum(c) OVER (PARTITION BY lang) + 2 * v)::HUGEINT AS q FROM whole JOIN v USING (lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, value::BIGINT AS value,
         row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP12_SQL = """
WITH wide AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL),
usable AS (
  SELECT * FROM wide WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score,
         row_number() OVER (PARTITION BY q.n ORDER BY list_distance(q.v, c.v), c.vec_id NULLS FIRST, c.n)::INT AS rank
  FROM usable q JOIN usable c ON q.n <> c.n AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP13_SQL = """
WITH RECURSIVE marked AS (
  SELECT *, list_reduce(
           list_concat([4294967295::UBIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::UBIGINT)),
           lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], list_transform(range(8), lambda z: 0::UBIGINT)), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS crc,
         concat(__FIELDS__) AS own, concat(__LONGER__) AS longer
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(own) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND xor(crc, 4294967295::UBIGINT) % 7 = 0 THEN sha256(longer) ELSE sha256(own) END AS held,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(own)) - 1 AS idx
  FROM marked),
levels AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT lang, level AS height, nodes[1] AS subroot FROM levels WHERE len(nodes) = 1),
tops AS (
  SELECT 0 AS level, list(subroot ORDER BY lang NULLS FIRST) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM tops WHERE len(nodes) > 1),
placed AS (SELECT lang, height, subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM subroots),
steps AS (
  SELECT l.lang, l.idx, v.level, coalesce(v.nodes[xor(l.idx >> v.level, 1) + 1], '') AS sibling, (l.idx >> v.level) & 1 AS side
  FROM leaves l JOIN levels v ON v.lang IS NOT DISTINCT FROM l.lang AND len(v.nodes) > 1
  UNION ALL
  SELECT l.lang, l.idx, p.height + t.level, coalesce(t.nodes[xor(p.place >> t.level, 1) + 1], ''), (p.place >> t.level) & 1
  FROM leaves l JOIN placed p ON p.lang IS NOT DISTINCT FROM l.lang JOIN tops t ON len(t.nodes) > 1),
folds AS (
  SELECT lang, idx, 0 AS level, held AS digest FROM leaves
  UNION ALL
  SELECT f.lang, f.idx, f.level + 1, sha256(CASE WHEN s.side = 1 THEN s.sibling || f.digest ELSE f.digest || s.sibling END)
  FROM folds f JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.idx = f.idx AND s.level = f.level),
ends AS (SELECT lang, idx, arg_max(digest, level) AS folded FROM folds GROUP BY ALL),
proofs AS (SELECT lang, idx, string_agg(sibling, '' ORDER BY level) AS proof FROM steps GROUP BY ALL),
root AS (SELECT nodes[1] AS root FROM tops WHERE len(nodes) = 1)
SELECT l.doc_id, l.leaf, p.subroot, r.root, sha256(coalesce(o.proof, '')) AS proof_sha256, e.folded AS folded_root, e.folded = r.root AS verified
FROM leaves l JOIN placed p ON p.lang IS NOT DISTINCT FROM l.lang
JOIN ends e ON e.lang IS NOT DISTINCT FROM l.lang AND e.idx = l.idx
LEFT JOIN proofs o ON o.lang IS NOT DISTINCT FROM l.lang AND o.idx = l.idx, root r
"""


def _fields(columns: str) -> str:
    """The leaf's fields in SQL: ``-`` for null, else the byte count, ``:`` and the value."""
    each = (f"coalesce(octet_length(encode(({c})::VARCHAR))::VARCHAR || ':' || ({c})::VARCHAR, '-')" for c in columns.split(", "))
    return ", ".join(each)


OP13_SQL = OP13_SQL.replace("__FIELDS__", _fields("doc_id, source, lang, n_chars, text"))
OP13_SQL = OP13_SQL.replace("__LONGER__", _fields("doc_id, source, lang, n_chars::HUGEINT + 1, text"))


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": OP1_SQL,
        "op7_chat_formatting": OP7_SQL,
        "op11_source_divergence": OP11_SQL,
        "op12_nearest_neighbours": OP12_SQL,
        "op13_merkle_manifest": OP13_SQL,
    }
