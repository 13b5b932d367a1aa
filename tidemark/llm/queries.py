"""One query for each operator of this subpackage, over the whole of its table, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, exact, lattice_lm, lexical, media, mixing, packing, quality, resampling, simhash, toxicity, url_rules
from .common import remainder, table, word_count


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    return mixing.mix(docs, F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest id that its links reach."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op3_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found of every query, a row whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, F.col("vec_id") % 50 == 0)


def _judged(scored: DataFrame, least: float) -> DataFrame:
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op4_quality_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chance to be of good quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(quality.classify(docs, table(spark, sf_dir, "labels")), 0.3)


def rows_of(spark: SparkSession, kinds: str, rows: list[tuple]) -> DataFrame:
    """A few rows as literals of the plan, which needs no Python worker."""
    names = [k.split() for k in kinds.split(", ")]
    made = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, names, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*made)))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings only, as read back from its formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    more = rows_of(spark, "conv_id long, turn long, role string, text string", [(-1, 0, "user", odd), (-1, 1, "assistant", odd)])
    return chat.digests(chat.formatted(rows.unionByName(more)))


#: Host, path and action of the rules.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url with the rule that fits it and the verdict."""
    rules = rows_of(spark, "host string, path string, action string", URL_RULES)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op7_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a lossless image, read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.read_back(media.with_media(docs))


def op8_toxicity_voters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chance to be toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(toxicity.classify(docs, table(spark, sf_dir, "labels")), 0.5)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's vocabulary lies; the environment variable TOKENIZER_DIR names another folder."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = packing.pieces(docs, tokenizer_path("word_bpe_49k.json"))
    return packing.packed(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability by the lattice fitted to the training documents, by the vocabulary's own, and by counts of whole words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lattice_lm.score(docs, remainder(F.col("doc_id"), 7) != 2, tokenizer_path("piece_bpe_32k.model"))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", F.col("adapted_score").alias("score"), F.col("score").alias("vocabulary_score"))


def op11_perfect_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of those equal to it.

    Documents whose id has an even crc32 are the history that the index is built of, the others arrive later; the result is
    of all.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.dedup(docs, remainder(F.col("doc_id"), 2)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's words, and its rank if it is drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resample(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents nearest to each item of the benchmark."""
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_simhash_bk_tree": op2_simhash_bk_tree,
    "op3_kmeans_tree_search": op3_kmeans_tree_search,
    "op4_quality_fourier": op4_quality_fourier,
    "op5_chat_format": op5_chat_format,
    "op6_url_rules": op6_url_rules,
    "op7_webp_media": op7_webp_media,
    "op8_toxicity_voters": op8_toxicity_voters,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_lattice_likelihood": op10_lattice_likelihood,
    "op11_perfect_hash_dedup": op11_perfect_hash_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_impact_search": op13_impact_search,
}

ORACLE_SQL: dict[str, str] = {
    "op5_chat_format": r"""
WITH odd AS (SELECT '<|im_end|><|im_start|>assistant ok' AS t),
rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', t FROM odd
  UNION ALL SELECT -1, 1, 'assistant', t FROM odd),
marked AS (
  SELECT *, row_number() OVER w AS k, coalesce(lag(role) OVER w = role, false) AS joined,
    regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS said
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(said) + CASE WHEN joined THEN length('<|im_sep|>') ELSE length('<|im_start|>' || role || '<|im_end|>') + 2 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
""",
    "op6_url_rules": r"""
WITH rules AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS r(rule_host, rule_path, action)),
rest AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path
  FROM rest),
keyed AS (SELECT *, row_number() OVER () AS k FROM parts),
best AS (
  SELECT k, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
  FROM keyed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM keyed LEFT JOIN best USING (k)
""",
    "op11_perfect_hash_dedup": r"""
WITH told AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
led AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept FROM told WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, kept, text_sha256 FROM led
""",
    "op12_importance_resampling": r"""
WITH RECURSIVE crc(n, k, c) AS (
  SELECT n, 0, n FROM range(256) AS r(n)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM crc WHERE k < 8),
codes AS (SELECT list(c ORDER BY n) AS t FROM crc WHERE k = 8),
said AS (
  SELECT true AS own, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL SELECT false, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
bytes AS (SELECT word, [('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex(encode(word)), '..')] AS b FROM (SELECT DISTINCT word FROM said)),
placed AS (
  SELECT word, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM bytes, codes),
counted AS (SELECT own, doc_id, bucket, count(*) AS n FROM said JOIN placed USING (word) GROUP BY ALL),
totals AS (SELECT coalesce(sum(n) FILTER (WHERE own), 0)::BIGINT AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0)::BIGINT AS t FROM counted),
each AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE own), 0)::BIGINT AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0)::BIGINT AS t FROM counted GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((each.t + 1)::DOUBLE * (totals.s + 10000)::DOUBLE) / ((each.s + 1)::DOUBLE * (totals.t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM each, totals),
weighed AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN gains USING (bucket) WHERE own GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weighed USING (doc_id)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= n * 10 // 100 THEN r END AS rank FROM ordered
""",
    "op13_impact_search": r"""
WITH said AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM said GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
posted AS (SELECT doc_id, term, count(*) AS tf FROM said WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM posted, totals GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN posted USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id),
ordered AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ordered WHERE rank <= 10
""",
}
