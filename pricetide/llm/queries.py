"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import (
    arc_to_warc,
    chat_preferences,
    context_mixing,
    decontamination,
    filter_audit,
    ngram_jaccard,
    quality_rules,
    secret_scan,
    sentencepiece_chunks,
    simhash,
    source_divergence,
    substring_dedup,
    toxicity,
)
from pricetide.llm.common import held_out, table

#: Where the public tokenizers' package lies; the model's own path can be given instead.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "")


def piece_model() -> str:
    """Path of the SentencePiece model."""
    return PIECE_MODEL or importlib.import_module("public_tokenizers").path("piece_bpe_32k.model")


def digest(text: F.Column) -> F.Column:
    """Lower-case hex SHA-256 of a text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(
        docs.where(~held_out(3)), table(spark, sf_dir, "labels").where(~held_out(3)), corpus=docs
    )
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out(3).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.7).cast("int").alias("predicted"),
        F.col("toxicity.evidence").alias("evidence"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("secrets")
    base = [r.kind for r in secret_scan.BASE]
    return secret_scan.find_secrets(docs).select(
        "doc_id",
        *(
            secret_scan.count_kind(spans, kind).alias(f"n_{kind}")
            for kind in base
        ),
        digest(secret_scan.joined(F.filter(spans, lambda s: s["kind"].isin(*base)))).alias("base_sha256"),
        secret_scan.joined(spans).alias("spans"),
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.col("pieces.ids")
    return sentencepiece_chunks.encode_and_decode(docs, piece_model()).select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        digest(F.array_join(ids.cast("array<string>"), ",")).alias("ids_sha256"),
        digest(F.col("pieces.decoded")).alias("decoded_sha256"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model).select("doc_id", "quality.*")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontamination.mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    found = F.col("contamination")
    return marked.select(
        "doc_id",
        found["n_words"].alias("n_words"),
        found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        digest(F.array_join(found["items"], ",")).alias("items_sha256"),
        decontamination.is_contaminated().alias("contaminated"),
    )


def spans_text(spans: F.Column) -> F.Column:
    """start:end, joined by commas."""
    each = F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def op8_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = chat_preferences.swapped_replies(table(spark, sf_dir, "conversations"))
    pairs = chat_preferences.preference_pairs(chosen, rejected)
    return pairs.select(
        F.col("pair_id").alias("conv_id"),
        "prompt_turns",
        "prompt",
        "chosen",
        "rejected",
        spans_text(F.col("chosen_mask")).alias("chosen_mask"),
        spans_text(F.col("rejected_mask")).alias("rejected_mask"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_texts(table(spark, sf_dir, "documents"), held_out(5))


def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_to_warc.archive_pages(table(spark, sf_dir, "pages"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.simhash_classes(table(spark, sf_dir, "documents"))
    return classes.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_toxicity": op2_toxicity,
    "op3_secret_scan": op3_secret_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_chat_preferences": op8_chat_preferences,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_arc_to_warc": op10_arc_to_warc,
    "op11_source_divergence": op11_source_divergence,
    "op12_simhash": op12_simhash,
    "op13_filter_audit": op13_filter_audit,
}

def _secrets_sql() -> str:
    """All rules' matches by the lengths of the pieces between them, joined per document."""
    # This SQL's engine folds case beyond A-Z, so the keys spell both cases out.
    both = "".join
    keys = "|".join(
        both(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key")
    )
    found = []
    for rank, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("(?i:password|passwd|secret|token|api_?key)", f"(?:{keys})").replace("'", "''")
        pattern = pattern.replace("((?:", "(?:", 1).replace("))[\"", ")[\"", 1) if rule.group else pattern
        group = 1 if rule.group else 0
        found.append(
            f"SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, {rule.least} AS least,"
            f" string_split_regex(t, '{pattern}') AS pieces, regexp_extract_all(t, '{pattern}') AS found,"
            f" regexp_extract_all(t, '{pattern}', {group}) AS measured"
            " FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
        )
    return f"""
WITH rules AS ({" UNION ALL ".join(found)}),
each AS (SELECT *, unnest(generate_series(1, len(found))) AS i FROM rules WHERE len(found) > 0),
placed AS (
  SELECT doc_id, kind, rank, len(found[i]) AS size,
    list_sum(list_transform(pieces[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x))), 0) AS pos
  FROM each WHERE len(measured[i]) >= least),
spans AS (
  SELECT doc_id, kind, rank, pos, kind || ':' || CAST(pos AS BIGINT) || ':' || CAST(pos + size AS BIGINT) AS span FROM placed),
joined AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
    count(*) FILTER (rank = 2) AS n_hex, string_agg(span, ',' ORDER BY pos, rank) FILTER (rank < 3) AS base,
    string_agg(span, ',' ORDER BY pos, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN joined USING (doc_id)"""


DECONTAMINATION_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
starts AS (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i:i + 12], ' ') AS body FROM starts),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM words, sizes WHERE len(w) >= size),
hits AS (
  SELECT p.doc_id, p.i, p.size, x.item FROM places p JOIN windows x
  ON x.size = p.size AND x.body = array_to_string(p.w[p.i:p.i + p.size - 1], ' ')),
hit_words AS (
  SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(generate_series(i, i + size - 1)) AS pos FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""".replace("\\\\", "\\")

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS size, sha1(body) AS digest FROM p),
r AS (
  SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY digest, size) ELSE page_id END AS best FROM d)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN best = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN best <> page_id THEN best END AS refers_to, true AS body_ok
FROM r"""

PREFERENCES_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(turn) AS turn FROM t WHERE role = 'assistant' GROUP BY conv_id),
reply AS (
  SELECT l.conv_id, l.turn, max(t.text) AS text FROM last l
  JOIN t ON t.conv_id = l.conv_id AND t.turn IS NOT DISTINCT FROM l.turn AND t.role = 'assistant' GROUP BY l.conv_id, l.turn),
swapped AS (
  SELECT t.* FROM t LEFT JOIN last l ON l.conv_id = t.conv_id
  WHERE l.conv_id IS NULL OR t.role <> 'assistant' OR t.turn IS DISTINCT FROM l.turn
  UNION ALL SELECT a.conv_id, a.turn, 'assistant', b.text FROM reply a JOIN reply b ON b.conv_id = xor(a.conv_id, 1)),
sides AS (SELECT 'chosen' AS side, * FROM t UNION ALL SELECT 'rejected', * FROM swapped),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY side, conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    turn || '/' || row_number() OVER (PARTITION BY side, conv_id, turn ORDER BY role, text) AS name FROM sides),
unlike AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, min(coalesce(c.place, r.place)) AS place
  FROM (SELECT * FROM placed WHERE side = 'chosen') c FULL JOIN (SELECT * FROM placed WHERE side = 'rejected') r
    ON r.conv_id = c.conv_id AND r.name IS NOT DISTINCT FROM c.name
  WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY 1),
parts AS (
  SELECT p.conv_id, CASE WHEN u.place IS NULL OR p.place < u.place THEN 'prompt' ELSE side END AS part, p.place, p.role,
    '<|' || role || '|>
' AS head, text || '<|end|>
' AS body
  FROM placed p LEFT JOIN unlike u ON u.conv_id = p.conv_id
  WHERE side = 'chosen' OR p.place >= u.place),
measured AS (
  SELECT *, sum(len(head) + len(body)) OVER (PARTITION BY conv_id, part ORDER BY place) AS stop FROM parts),
joined AS (
  SELECT conv_id, part, count(*) AS turns, string_agg(head || body, '' ORDER BY place) AS body,
    string_agg(CAST(stop - len(body) AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY place) FILTER (role = 'assistant') AS mask
  FROM measured GROUP BY conv_id, part),
both_sides AS (SELECT conv_id FROM sides GROUP BY conv_id HAVING count(DISTINCT side) = 2)
SELECT b.conv_id, coalesce(p.turns, 0) AS prompt_turns, coalesce(p.body, '') AS prompt, coalesce(c.body, '') AS chosen,
  coalesce(r.body, '') AS rejected, coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM both_sides b
LEFT JOIN joined p ON p.conv_id = b.conv_id AND p.part = 'prompt'
LEFT JOIN joined c ON c.conv_id = b.conv_id AND c.part = 'chosen'
LEFT JOIN joined r ON r.conv_id = b.conv_id AND r.part = 'rejected'"""

JACCARD_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM texts WHERE len(w) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * k >= 75 * (a.n + b.n - k)),
reached AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y),
least AS (SELECT x, min(y) AS y FROM reached GROUP BY x),
degrees AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, least(t.doc_id, coalesce(least.y, t.doc_id)) AS component_id,
  coalesce(n_links, 0) AS n_links
FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id LEFT JOIN least ON least.x = t.doc_id
LEFT JOIN degrees d ON d.x = t.doc_id""".replace("\\\\", "\\")

DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT row, lang, source, unnest(w) AS term FROM d),
kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM places GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
held AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM places JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM held GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(h.n, 0) + 1) // (coalesce(t.total, 0) + s.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 1) // (s.total + s.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN sizes s ON s.lang = g.lang
  LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200""".replace("\\\\", "\\")

FILTER_AUDIT_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(w) < 200 AS INT)
    + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
    + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(w.doc_id > first, false) AS INT) AS mask
  FROM w LEFT JOIN marks ON marks.doc_id = w.doc_id),
g AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT '' AS filter_order, 0 AS used
  UNION ALL SELECT filter_order || letter, used + bit FROM orders, letters WHERE used & bit = 0),
steps AS (
  SELECT filter_order, step, letter, bit,
    (SELECT coalesce(sum(x.bit), 0) FROM letters x WHERE position(x.letter IN left(filter_order, step - 1)) > 0)::INT AS before
  FROM (SELECT filter_order, unnest(generate_series(1, 5)) AS step FROM orders WHERE used = 31) o
  JOIN letters ON letter = substr(filter_order, step, 1)),
sums AS (
  SELECT part, filter_order, step, letter,
    sum(n) FILTER (mask & (before + bit) = 0) AS kept,
    sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
    sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost,
    sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost
  FROM g, steps GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
  CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM sums""".replace("\\\\", "\\")

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": JACCARD_SQL,
    "op3_secret_scan": _secrets_sql(),
    "op7_decontamination": DECONTAMINATION_SQL,
    "op8_chat_preferences": PREFERENCES_SQL,
    "op10_arc_to_warc": WARC_SQL,
    "op11_source_divergence": DIVERGENCE_SQL,
    "op13_filter_audit": FILTER_AUDIT_SQL,
}
