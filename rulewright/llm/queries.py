"""Queries over the corpus tables, one for each operator, and the SQL of those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, crossentropy, exact, interactions, langid, licenses, media, merkle, minmax, mixing, periodic, pieces, quality, wrappers

#: Place of the vocabulary that texts are encoded with.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"

#: The rule by which op1 damages records of its second replica: page_id % DAMAGE[0] = DAMAGE[1]; in
#: turn one is altered, one is longer, one is shorter and one is missing.
DAMAGE = (97, 13)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of an archive file, audited against a replica with planted damage."""
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), merkle.warc_record(F.col("url"), F.col("html"), F.col("page_id")).alias("record"))
    kind = F.when(F.col("record_id") % DAMAGE[0] == DAMAGE[1], F.floor(F.col("record_id") / DAMAGE[0]) % 4)
    damaged = F.when(kind == 0, F.overlay("record", F.lit("0"), F.lit(8))).when(kind == 1, F.concat("record", F.lit("\n"))).when(kind == 2, F.substring("record", 1, F.length("record") - 1)).otherwise(F.col("record"))
    other = pages.where(F.coalesce(kind != 3, F.lit(True))).withColumn("record", damaged)
    loose = merkle.loose_files(pages)
    return merkle.audit(*(merkle.archive_layout(x, loose=loose) for x in (pages, other)))


def _op1_level(below: str, node: str, name: str) -> str:
    return f"""SELECT file, {node} AS node, min(first) AS first, max(last) AS last,
    sha256('node|' || string_agg({name}::varchar, ',' ORDER BY first) || '|' || string_agg((last - first)::varchar || ':' || hash, '|' ORDER BY first)) AS hash
  FROM {below} GROUP BY file, {node}"""


OP1_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha256(coalesce(page_id::varchar, '') || '|' || coalesce(url, '')) AS s FROM pages
), r AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
    || s[1:8] || '-' || s[9:12] || '-' || s[13:16] || '-' || s[17:20] || '-' || s[21:32] || '>' || chr(13) || chr(10) || 'WARC-Date: {merkle.NO_DATE}' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)::varchar
    || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM p
), l AS (
  SELECT page_id AS record_id, sha256(record) AS digest, strlen(record)::bigint AS length, count(*) AS copies FROM r GROUP BY 1, 2, 3
), f AS (
  SELECT *, (record_id // {merkle.FILE_RECORDS})::bigint AS file FROM l
), o AS (
  SELECT *, row_number() OVER w - 1 AS leaf, coalesce(sum(length * copies) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS "offset"
  FROM f WINDOW w AS (PARTITION BY file ORDER BY record_id NULLS FIRST, digest)
), n AS (
  SELECT file, record_id % {merkle.FILE_RECORDS} AS node, record_id, "offset" AS first, "offset" + length * copies AS last,
    sha256('leaf|' || record_id || '|' || length || '|' || copies || '|' || digest) AS hash FROM o
), n0 AS ({_op1_level("n", "node", "record_id")}
), n1 AS ({_op1_level("n0", f"node // {merkle.FANOUT}", "node")}
), n2 AS ({_op1_level("n1", f"node // {merkle.FANOUT}", "node")}
), n3 AS ({_op1_level("n2", f"node // {merkle.FANOUT}", "node")}
)
SELECT o.file, leaf, "offset", length, record_id, digest, copies, n3.hash AS root,
  CASE WHEN record_id % {DAMAGE[0]} <> {DAMAGE[1]} THEN 'intact' WHEN record_id // {DAMAGE[0]} % 4 = 3 THEN 'missing' ELSE 'damaged' END AS status,
  coalesce(record_id % {DAMAGE[0]} <> {DAMAGE[1]}, true) AS intact
FROM o JOIN n3 USING (file)
"""


def op2_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), MODEL_PATH)


def op3_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, _table(spark, sf_dir, "documents"))


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mixture; weights to nine decimals, as engines differ in the last digit of a power."""
    return mixing.mix(_table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 9))


OP4_SQL = f"""
WITH RECURSIVE c AS (
  SELECT source, count(*) AS n FROM documents GROUP BY 1
), w AS (
  SELECT source, n, pow(n::double, {mixing.TEMPERATURE}) / sum(pow(n::double, {mixing.TEMPERATURE})) OVER () AS w, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM c
), l AS (
  SELECT list(w ORDER BY i) AS w, greatest({mixing.PERIOD}, 8 * count(*), ceil(min(ceil(n / {mixing.BLOCK_ROWS}.0) / w)))::bigint AS q FROM w
), sim AS (
  SELECT 0::bigint AS t, [0::bigint FOR x IN w] AS done, 0::bigint AS pick, 0::bigint AS k, w, q FROM l
  UNION ALL
  SELECT t + 1, [CASE WHEN j = p THEN done[j] + 1 ELSE done[j] END FOR j IN range(1, len(w) + 1)], p, done[p], w, q FROM (
    SELECT *, list_position(due, list_min(due))::bigint AS p FROM (
      SELECT t, done, w, q, [CASE WHEN floor(done[j] / w[j] + {mixing.NEAR}) <= t THEN ceil((done[j] + 1) / w[j] - {mixing.NEAR}) ELSE 'infinity'::double END FOR j IN range(1, len(w) + 1)] AS due
      FROM sim WHERE t < q
    )
  )
), slots AS (
  SELECT pick AS i, k, t - 1 AS o FROM sim WHERE t > 0
), offsets AS (
  SELECT * FROM slots
  UNION ALL
  SELECT w.i, 0, l.q + row_number() OVER (ORDER BY w.i) - 1 FROM w, l WHERE w.i NOT IN (SELECT i FROM slots)
), period AS (
  SELECT max(o) + 1 AS len FROM offsets
), known AS (
  SELECT w.i, w.source, w.w, count(*) AS pp FROM w JOIN offsets USING (i) GROUP BY 1, 2, 3
), r AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY ('0x' || md5('mix' || coalesce(doc_id::varchar, ''))[1:15])::bigint, doc_id) - 1 AS row_no FROM documents
), b AS (
  SELECT r.*, known.i, known.w, pp, row_no // {mixing.BLOCK_ROWS} AS block_no, row_no // {mixing.BLOCK_ROWS} % pp AS kk FROM r JOIN known ON r.source IS NOT DISTINCT FROM known.source
)
SELECT doc_id, source, round(b.w, 9) AS weight, row_no::bigint AS row_no, block_no::bigint AS block_no,
  (block_no // pp * len + CASE WHEN o >= q THEN q ELSE floor(kk / b.w + {mixing.NEAR}) END)::bigint AS release,
  (block_no // pp * len + CASE WHEN o >= q THEN len ELSE ceil((kk + 1) / b.w - {mixing.NEAR}) END)::bigint AS deadline,
  (block_no // pp * len + o)::bigint AS slot
FROM b JOIN offsets ON b.i = offsets.i AND b.kk = offsets.k, period, l
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op7_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op8_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored for likeness to the ones labelled good and not toxic, each without its own counts."""
    clean = _table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    out = crossentropy.score(_table(spark, sf_dir, "documents"), clean, least_vocabulary=0, own_counts=False)
    # six decimals: engines add in different orders
    return out.select("doc_id", "n_tokens", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("target_loss", "background_loss", "difference")])


def _op8_loss(side: str) -> str:
    mine = f"CASE WHEN t.is_target THEN {1 if side == 'target' else 0} ELSE {0 if side == 'target' else 1} END"
    p1 = f"(u.{side} - {mine} * t.own + {crossentropy.SMOOTH}) / (n.{side} - {mine} * t.size + {crossentropy.SMOOTH} * n.v)"
    context = f"CASE WHEN t.pos = 1 THEN n.{side}_texts - {mine} ELSE c.{side} - {mine} * t.prev_own END"
    return f"-log2({crossentropy.BIGRAM} * (b.{side} - {mine} * t.pair_own + {p1}) / ({context} + 1) + {1 - crossentropy.BIGRAM} * {p1})"


OP8_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL) AS is_target,
    [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS words FROM documents
), t0 AS (
  SELECT rn, is_target, len(words) AS size, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM d
), t1 AS (
  SELECT *, lag(w) OVER (PARTITION BY rn ORDER BY pos) AS prev, count(*) OVER (PARTITION BY rn, w) AS own FROM t0
), t AS (
  SELECT *, count(*) OVER (PARTITION BY rn, prev, w) AS pair_own, lag(own) OVER (PARTITION BY rn ORDER BY pos) AS prev_own FROM t1
), u AS (
  SELECT w, count(*) FILTER (WHERE is_target) AS target, count(*) FILTER (WHERE NOT is_target) AS background FROM t GROUP BY w
), b AS (
  SELECT prev, w, count(*) FILTER (WHERE is_target) AS target, count(*) FILTER (WHERE NOT is_target) AS background FROM t GROUP BY prev, w
), n AS (
  SELECT sum(target) AS target, sum(background) AS background, count(*) AS v,
    (SELECT count(*) FROM d WHERE is_target AND len(words) > 0) AS target_texts, (SELECT count(*) FROM d WHERE NOT is_target AND len(words) > 0) AS background_texts FROM u
), s AS (
  SELECT t.rn, avg({_op8_loss("target")}) AS target_loss, avg({_op8_loss("background")}) AS background_loss
  FROM t JOIN u ON t.w = u.w JOIN b ON t.w = b.w AND t.prev IS NOT DISTINCT FROM b.prev LEFT JOIN u c ON t.prev = c.w, n GROUP BY t.rn
)
SELECT doc_id, len(words)::bigint AS n_tokens, round(target_loss, 6) + 0.0 AS target_loss, round(background_loss, 6) + 0.0 AS background_loss,
  round(target_loss - background_loss, 6) + 0.0 AS difference
FROM d LEFT JOIN s USING (rn)
"""


def op9_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(_table(spark, sf_dir, "documents"), threshold=(85, 100), perms=96)


OP9_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rn, doc_id,
    [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS words FROM documents
), s AS (
  SELECT DISTINCT rn, array_to_string(words[k : k + 4], ' ') AS shingle FROM (SELECT rn, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS k FROM d WHERE len(words) > 0)
), n AS (
  SELECT rn, count(*) AS size FROM s GROUP BY rn
), links AS (
  SELECT a.rn AS x, b.rn AS y FROM s a JOIN s b USING (shingle) JOIN n na ON a.rn = na.rn JOIN n nb ON b.rn = nb.rn WHERE a.rn <> b.rn
  GROUP BY a.rn, b.rn, na.size, nb.size HAVING 100 * count(*) >= 85 * (na.size + nb.size - count(*))
), reach AS (
  SELECT rn AS x, rn AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), c AS (
  SELECT x AS rn, min(e.doc_id) AS component_id FROM reach JOIN d e ON reach.y = e.rn GROUP BY x
)
SELECT doc_id, coalesce(n.size, 0)::bigint AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (rn) LEFT JOIN n USING (rn)
"""


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(_table(spark, sf_dir, "documents"), plant=True)


def op13_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(_table(spark, sf_dir, "pages"))


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op5_license_scan`` finds of the base phrases, which SQL can find too; no place is -1."""
    place = lambda c: F.coalesce(c, F.lit(-1)).cast("long").alias(c)
    return op5_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", place("first_word"), place("last_word"), "base_labels")


LICENSE_BASE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT rn, i - 1 AS place, label FROM (SELECT rn, w, unnest(range(1, len(w) + 1)) AS i FROM d), (VALUES ('mit', ['mit', 'license']), ('apache', ['apache', 'license']), ('gpl', ['general', 'public', 'license'])) v(label, phrase)
  WHERE w[i] = phrase[1] AND w[i : i + len(phrase) - 1] = phrase
), f AS (
  SELECT rn, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY rn
)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, coalesce(first_word, -1)::bigint AS first_word, coalesce(last_word, -1)::bigint AS last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN f USING (rn)
"""


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads that ``op6_media_columns`` reads back, which SQL can work out from the texts."""
    return op6_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


MEDIA_PAYLOADS_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, ''))::bigint AS n FROM documents
), p AS (
  SELECT doc_id, text, n, greatest((n + 191) // 192, 1) * 192 AS m FROM d
)
SELECT doc_id, n AS n_bytes, m::bigint AS payload_bytes, sha256(text || repeat(' ', m - n)) AS payload_sha256 FROM p
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_merkle_fixity": op1_merkle_fixity,
    "op2_sentencepiece_nbest": op2_sentencepiece_nbest,
    "op3_language_codes": op3_language_codes,
    "op4_pfair_mixing": op4_pfair_mixing,
    "op5_license_scan": op5_license_scan,
    "op6_media_columns": op6_media_columns,
    "op7_exact_duplicates": op7_exact_duplicates,
    "op8_cross_entropy": op8_cross_entropy,
    "op9_minmax_near_duplicates": op9_minmax_near_duplicates,
    "op10_ordinal_quality": op10_ordinal_quality,
    "op11_filter_interactions": op11_filter_interactions,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_wrapper_extraction": op13_wrapper_extraction,
    "license_base_places": license_base_places,
    "media_payloads": media_payloads,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op1_merkle_fixity": OP1_SQL,
    "op4_pfair_mixing": OP4_SQL,
    "op7_exact_duplicates": exact.ORACLE,
    "op8_cross_entropy": OP8_SQL,
    "op9_minmax_near_duplicates": OP9_SQL,
    "op11_filter_interactions": interactions.ORACLE,
    "license_base_places": LICENSE_BASE_SQL,
    "media_payloads": MEDIA_PAYLOADS_SQL,
}
