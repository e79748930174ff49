"""Queries of the training-data operators, and their SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitgrain.llm import bpe_codec, exact_dedup, fingerprints, line_quality, mixing, ngram_join, ordinal_quality, parse_dedup, sentence_spans, spelling, token_counts, warc_zstd, whitening
from commitgrain.llm._common import table


def op1_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.span_dedup(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = ordinal_quality.graded(table(spark, sf_dir, "labels"))
    return ordinal_quality.ordinal_quality(table(spark, sf_dir, "documents"), ratings)


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_rules(table(spark, sf_dir, "documents"))


def op6_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_parse_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_dedup.parse_dedup(table(spark, sf_dir, "documents"))


def op8_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.pages_through_archives(table(spark, sf_dir, "pages"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentence_spans": op1_sentence_spans,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_ordinal_quality": op4_ordinal_quality,
    "op5_line_quality": op5_line_quality,
    "op6_pareto_mix": op6_pareto_mix,
    "op7_parse_dedup": op7_parse_dedup,
    "op8_warc_zstd": op8_warc_zstd,
    "op9_ngram_join": op9_ngram_join,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_whitening": op12_whitening,
    "op13_fingerprints": op13_fingerprints,
}

#: The ASCII letters, for lower case as the contracts have it.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_sentence_spans": r"""
        WITH p AS (SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS piece FROM
              (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?]+[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*)', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents)),
          q AS (SELECT *, array_to_string(regexp_extract_all(piece, '[^\x20\x09-\x0D]+'), ' ') AS plain FROM p WHERE piece <> ''),
          n AS (SELECT *, CAST(sum(CASE WHEN plain <> '' OR first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS BIGINT) AS s FROM
              (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) = 1 AS first FROM q)),
          s AS (SELECT doc_id, s, string_agg(piece, '' ORDER BY k) AS raw, max(plain) AS plain, max(len(regexp_extract_all(piece, '[^\x20\x09-\x0D]+'))) AS w FROM n GROUP BY doc_id, s),
          c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY s) AS upto FROM s),
          f AS (SELECT a.doc_id, a.s AS i, b.s + 1 AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.s BETWEEN a.s AND a.s + 22 WHERE b.upto - a.upto + a.w >= 20 AND (b.s > a.s OR a.w >= 50)),
          r AS (SELECT doc_id, i, min(j) AS j FROM f GROUP BY doc_id, i UNION SELECT doc_id, max(i), j FROM f GROUP BY doc_id, j),
          t AS (SELECT r.doc_id, i, j, list(plain ORDER BY s) AS run FROM r JOIN s ON s.doc_id = r.doc_id AND s.s >= i AND s.s < j GROUP BY r.doc_id, i, j),
          o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM t),
          g AS (SELECT DISTINCT doc_id, unnest(range(i, j)) AS s FROM o WHERE k > 1),
          m AS (SELECT s.*, g.s IS NOT NULL AS gone FROM s LEFT JOIN g ON s.doc_id = g.doc_id AND s.s = g.s),
          e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY s), false) AS begins FROM m),
          x AS (SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, CAST(coalesce(sum(w) FILTER (gone), 0) AS BIGINT) AS removed_words,
              coalesce(string_agg(raw, '' ORDER BY s) FILTER (NOT gone), '') AS text FROM e GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(removed_words, 0) AS removed_words,
            sha256(coalesce(x.text, '')) AS kept_sha256, coalesce(x.text, '') AS text FROM documents d LEFT JOIN x USING (doc_id)""",
    "op5_line_quality": r"""
        WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
          i AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS k, w FROM w),
          r AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, w[k:k + 7]) AS n FROM i),
          h AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM r WHERE n > 1) GROUP BY doc_id),
          l AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM w),
          f AS (SELECT doc_id, source, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS key FROM l),
          v AS (SELECT * FROM f WHERE len(key) > 0),
          dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM v GROUP BY doc_id),
          per AS (SELECT doc_id, source, key, sum(len(key)) AS words FROM v GROUP BY doc_id, source, key),
          host AS (SELECT source, greatest(20.0, count(*) * 0.02) AS cap FROM documents GROUP BY source),
          over AS (SELECT source, key FROM per JOIN host USING (source) GROUP BY source, key, cap HAVING count(*) > cap),
          gone AS (SELECT doc_id, sum(words) AS words, count(*) AS n FROM per JOIN over USING (source, key) GROUP BY doc_id),
          a AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
              coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(words, 0) AS BIGINT) AS removed_words, coalesce(n, 0) AS removed_lines
              FROM w LEFT JOIN h USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
            NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - removed_words >= n_words * 0.5 AND n_words - removed_words >= 20 AS kept FROM a""",
    "op6_pareto_mix": r"""
        WITH RECURSIVE d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS h, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
            row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) AS number FROM documents),
          s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY source),
          w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight FROM s),
          b AS (SELECT *, 3.0::DOUBLE * ss / weight AS bound FROM w),
          l AS (SELECT *, (sum(ss) OVER () - coalesce(sum(3.0::DOUBLE * ss) OVER (ORDER BY bound, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY bound, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM b),
          t AS (SELECT source, ss, least(3.0::DOUBLE * ss, coalesce((SELECT max(level) FROM l WHERE level <= bound), (SELECT max(bound) FROM l)) * weight) AS target FROM l),
          k AS (SELECT source, length(bin(size)) - 1 AS k, CAST(sum(size) AS DOUBLE) AS words FROM d GROUP BY ALL),
          i AS (SELECT source, 0 AS step, -200.0::DOUBLE AS lo, 200.0::DOUBLE AS hi FROM t UNION ALL
              SELECT i.source, step + 1, CASE WHEN f < target - floor(target / ss) * ss THEN (lo + hi) / 2 ELSE lo END, CASE WHEN f < target - floor(target / ss) * ss THEN hi ELSE (lo + hi) / 2 END
              FROM i JOIN t ON i.source IS NOT DISTINCT FROM t.source, LATERAL (SELECT sum(words * pow(2.0::DOUBLE, (lo + hi) / 2 + k * 0.5::DOUBLE) / (1 + pow(2.0::DOUBLE, (lo + hi) / 2 + k * 0.5::DOUBLE))) AS f
                  FROM k WHERE k.source IS NOT DISTINCT FROM i.source) x WHERE step < 60),
          r AS (SELECT d.*, ss, target, floor(target / ss) AS whole, target - floor(target / ss) * ss AS rest, (lo + hi) / 2 AS factor,
              md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), '-'), h, CAST(number AS VARCHAR), 'mix-1')) AS tag
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN i ON d.source IS NOT DISTINCT FROM i.source AND step = 60),
          u AS (SELECT *, (CAST('0x' || substring(tag, 1, 12) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE AS u FROM r),
          o AS (SELECT *, CASE WHEN rest > 0 AND size > 0 THEN u / (1 - u) / pow(2.0::DOUBLE, factor + (length(bin(size)) - 1) * 0.5::DOUBLE) END AS rank FROM u),
          c AS (SELECT *, CASE WHEN rank IS NOT NULL THEN sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, tag ROWS UNBOUNDED PRECEDING) END AS upto FROM o),
          g AS (SELECT source, max(rest) - coalesce(max(upto) FILTER (upto <= rest), 0) AS gap FROM c WHERE rank IS NOT NULL GROUP BY source HAVING max(upto) > max(rest)),
          p AS (SELECT c.tag FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source WHERE upto > rest AND abs(size - gap) < gap
              QUALIFY row_number() OVER (PARTITION BY c.source ORDER BY abs(size - gap), rank, tag) = 1)
        SELECT doc_id, size, ss AS source_size, target, CAST(size * (coalesce(whole, 0) + CASE WHEN upto <= rest OR p.tag IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM c LEFT JOIN p ON c.tag = p.tag""",
    "op9_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
          g AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, CASE WHEN len(w) = 0 THEN NULL WHEN len(w) < 4 THEN w ELSE w[k:k + 3] END AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM w)) WHERE g IS NOT NULL),
          n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
          p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
          l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
          e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
          r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)""",
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
    "op8_warc_zstd": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
             g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM g""",
}
