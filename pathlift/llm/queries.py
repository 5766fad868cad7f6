"""One registered query per operator, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pathlift.session import steps_dir

from . import (
    byte_bpe, exact_dedup, fingerprints, langid, line_dedup, merkle, near_dedup, packing, quality, resampling, token_table,
    topk, toxicity,
)
from .common import crc_fold, cut_lineage, table

TOXIC_FOLDS, LANGUAGE_FOLDS = 5, 3
WORD_FILE = "word_bpe_49k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE), end_id=1, window=2048)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), folds=TOXIC_FOLDS)
    return docs.select(
        "doc_id", F.coalesce(crc_fold("doc_id", TOXIC_FOLDS) == 0, F.lit(False)).alias("held_out"),
        toxicity.score(model, F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.labelled(table(spark, sf_dir, "documents"), words=4, radius=4, keep=["doc_id"])
    return found.select("row.doc_id", "fingerprint", "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = line_dedup.cleaned(pages, line_dedup.host_of(F.col("url")), line_dedup.html_text(F.col("html")), keep=["page_id"])
    return found.select("row.page_id", "host", "n_lines", "n_kept", "text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, folds=LANGUAGE_FOLDS, held_out=1)
    found = docs.select(
        "doc_id", F.coalesce(crc_fold("doc_id", LANGUAGE_FOLDS) == 1, F.lit(False)).alias("held_out"),
        langid.judged(model, F.col("text")).alias("j"))
    return found.select(
        "doc_id", "held_out", F.col("j.lang").alias("lang_pred"), "j.score", "j.margin", "j.accepted")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host of a document is its source, the path within the host its language section."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.scored(docs, labels, F.col("source"), F.col("lang"), folds=TOXIC_FOLDS)


def op9_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{steps_dir(spark)}/token-table-{uuid.uuid4().hex}"
    token_table.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_FILE), end_id=2)
    rows = token_table.read(spark, path, ["doc_id", "ids", "pos"]).select(
        "doc_id", "pos", F.size("ids").cast("long").alias("n_tokens"), token_table.ids_crc32("ids").alias("ids_crc32"))
    # The ids are read back once; sums and starts work on the figures.
    return token_table.starts(cut_lineage(rows)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_proofs(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_toxicity, op3_near_dedup, op4_line_dedup, op5_language_id, op6_exact_dedup, op7_byte_bpe,
    op8_quality, op9_token_table, op10_fingerprints, op11_merkle_manifest, op12_resampling, op13_top_k,
)}


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _line_dedup_sql() -> str:
    text = f"regexp_replace(html, {_literal(line_dedup.UNSEEN)}, '', 'g')"
    text = f"regexp_replace({text}, {_literal(line_dedup.BREAKS)}, chr(10), 'g')"
    text = f"regexp_replace({text}, {_literal(line_dedup.TAGS)}, '', 'g')"
    for entity, char in line_dedup.ENTITIES:
        text = f"replace({text}, {_literal(entity)}, {_literal(char)})"
    tidy = f"trim(regexp_replace(x, {_literal(line_dedup.SPACES)}, ' ', 'g'), ' ')"
    return f"""
WITH raw AS (
  SELECT row_number() OVER () AS rid, page_id,
         nullif(lower(regexp_extract(url, {_literal(line_dedup.HOST)}, 1)), '') AS host,
         coalesce(list_filter(list_transform(string_split({text}, chr(10)), lambda x: {tidy}), lambda x: x <> ''), []) AS lines
  FROM pages),
listed AS (SELECT rid, host, unnest(list_distinct(lines)) AS line FROM raw WHERE host IS NOT NULL),
counted AS (SELECT host, line, count(*) AS n FROM listed GROUP BY ALL),
totals AS (SELECT host, count(*) AS total FROM raw GROUP BY host),
bad AS (
  SELECT counted.host, line FROM counted JOIN totals ON counted.host = totals.host
  WHERE n >= {line_dedup.LEAST_PAGES} AND n > total * {line_dedup.RATIO}),
hits AS (SELECT rid, list(listed.line) AS gone FROM listed JOIN bad USING (host, line) GROUP BY rid),
left_over AS (
  SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS rest
  FROM raw LEFT JOIN hits USING (rid))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, len(rest)::BIGINT AS n_kept,
       coalesce(array_to_string(rest, chr(10)), '') AS text
FROM left_over"""


_EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body,
         row_number() OVER () AS rid
  FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
             row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST, rid) AS place FROM t)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM g"""

#: crc32 byte by byte: a table from the bitwise rule, then one look-up for each byte of the hexadecimal text ``h``.
_CRC_TABLE = """
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS tab)"""


def _crc_sql(blob: str) -> str:
    """crc32 of a blob; ``crc_table`` must be joined."""
    octets = f"list_transform(range(octet_length({blob})), lambda i: ('0x' || substr(hex({blob}), (2 * i + 1)::INT, 2))::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295, {octets}), "
            "lambda c, b: xor(c >> 8, tab[((xor(c, b) & 255) + 1)::INT])), 4294967295)")


def _merkle_sql() -> str:
    def framed(column: str) -> str:
        return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(framed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def levels(name: str, start: str) -> str:
        return f"""
{name}(grp, level, pos, hash, n) AS (
  {start}
  UNION ALL
  SELECT grp, level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM {name} WHERE n > 1 GROUP BY grp, level, pos // 3)"""

    def sides(name: str) -> str:
        run = "OVER (PARTITION BY grp, level, pos // 3 ORDER BY pos"
        return f"""
{name}_sides AS (
  SELECT grp, level, pos,
         coalesce(string_agg(hash, '') {run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(hash, '') {run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name} WHERE n > 1)"""

    def paths(name: str, key: str) -> str:
        return f"""
{name}_paths AS (
  SELECT b.grp, b.pos, list({{'l': s.l, 'r': s.r}} ORDER BY s.level) AS steps
  FROM {name} b JOIN {name}_sides s ON s.grp IS NOT DISTINCT FROM b.grp AND s.pos = b.pos // (3 ** s.level)::BIGINT
  WHERE b.level = 0 GROUP BY b.grp, b.pos)"""

    return f"""
WITH RECURSIVE {_CRC_TABLE},
raw AS (
  SELECT doc_id, source, {leaf('text')} AS leaf,
         CASE WHEN {_crc_sql('encode(doc_id::VARCHAR)')} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS tampered
  FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n FROM raw),
{levels('low', 'SELECT source, 0, pos, leaf, n FROM placed')},
subroots AS (
  SELECT grp, hash, row_number() OVER (ORDER BY encode(grp) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
{levels('high', 'SELECT 0, 0, pos, hash, n FROM subroots')},
{sides('low')}, {sides('high')}, {paths('low', 'grp')}, {paths('high', 'grp')},
whole AS (
  SELECT doc_id, leaf, coalesce(tampered, leaf) AS claimed, s.hash AS subroot,
         (SELECT hash FROM high WHERE n = 1) AS root,
         list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
  FROM placed p JOIN subroots s ON s.grp IS NOT DISTINCT FROM p.source
  LEFT JOIN low_paths a ON a.grp IS NOT DISTINCT FROM p.source AND a.pos = p.pos
  LEFT JOIN high_paths b ON b.pos = s.pos),
folded AS (
  SELECT *, list_reduce(list_prepend({{'l': claimed, 'r': ''}}, steps),
           lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root,
       sha256(array_to_string(list_transform(steps, lambda s: s.l || s.r), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified FROM folded"""


def _resampling_sql() -> str:
    def features(name: str, source: str, key: str) -> str:
        lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        grams = " UNION ALL ".join(
            f"SELECT rid, unnest(list_transform(range(1, len(w) - {n - 2}), "
            f"lambda i: array_to_string(w[i : i + {n - 1}], ' '))) AS feature FROM {name}_words" for n in (1, 2, 3))
        return f"""
{name}_words AS (
  SELECT {key}, row_number() OVER () AS rid,
         regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {source}),
{name} AS ({grams})"""

    return f"""
WITH {_CRC_TABLE},
{features('src', 'documents', 'doc_id')},
{features('goal', 'benchmark', 'item_id')},
terms AS (SELECT DISTINCT feature FROM (SELECT feature FROM src UNION ALL SELECT feature FROM goal)),
bucketed AS (SELECT feature, {_crc_sql('encode(feature)')} % 10000 AS bucket FROM terms, crc_table),
s AS (SELECT bucket, count(*) AS n FROM src JOIN bucketed USING (feature) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM goal JOIN bucketed USING (feature) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(
    ((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM src) + 10000))::DOUBLE
    / ((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM goal) + 10000))::DOUBLE))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM bucketed) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
sums AS (
  SELECT rid, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM src JOIN bucketed USING (feature) JOIN gains USING (bucket) GROUP BY rid),
scored AS (
  SELECT doc_id, rid, len(w) >= 20 AS may, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
           + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM src_words LEFT JOIN sums USING (rid)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id NULLS LAST) AS place,
         count(*) OVER (PARTITION BY may) AS many FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 5 * many // 100 THEN place END AS rank FROM placed"""


_TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.rid <> c.rid)
SELECT query_id, (row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 5"""

ORACLE = {
    "op4_line_dedup": _line_dedup_sql(), "op6_exact_dedup": _EXACT_SQL, "op11_merkle_manifest": _merkle_sql(),
    "op12_resampling": _resampling_sql(), "op13_top_k": _TOP_K_SQL,
}
