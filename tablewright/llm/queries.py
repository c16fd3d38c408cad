"""Queries of this subpackage over the whole tables, with the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, linededup, mixing, ngramjoin, suffixdedup, tokencount, topk, toxicity, warc
from ._shared import table

#: ASCII lower case, ASCII punctuation and white space as blanks: how n-gram joins see a text.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_bpe(spark, sf_dir):
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_warc(spark, sf_dir):
    return warc.reassemble(warc.page_records(table(spark, sf_dir, "pages")))


def op4_line_dedup(spark, sf_dir):
    return linededup.line_dedup(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark, sf_dir):
    return suffixdedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_token_counts(spark, sf_dir):
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark, sf_dir):
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), queries="id % 100 = 0")


def op8_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"), power=mixing.POWER)


def op9_ann(spark, sf_dir):
    return ann.neighbours(table(spark, sf_dir, "embeddings"), queries="id % 100 = 0")


def op10_ngram_jaccard(spark, sf_dir):
    return ngramjoin.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_toxicity, op3_warc, op4_line_dedup, op5_suffix_dedup, op6_token_counts, op7_exact_top_k, op8_mixing, op9_ann, op10_ngram_jaccard)}

ORACLES = {
    # a page's HTTP message: 92 bytes of head and last chunk, 7 for the framing of a full chunk of 2048 bytes
    "op3_warc": r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
q AS (SELECT *, 92 + n + 7 * (n // 2048) + CASE WHEN n % 2048 = 0 THEN 0 ELSE 4 + length(format('{:x}', n % 2048)) END AS total FROM p)
SELECT '<urn:page:' || page_id || '>' AS record_id, url AS target_uri, CAST(ceil(total / 8192) AS INTEGER) AS n_segments,
       CAST(total AS BIGINT) AS total_length, 'ok' AS status, html AS payload FROM q""",
    "op5_suffix_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[\x09-\x0d\x1c-\x1f ]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL
), i AS (
  SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM w WHERE len(w) >= 50
), v AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS v FROM i
), r AS (
  SELECT v FROM v GROUP BY v HAVING count(DISTINCT doc_id) > 1
), h AS (
  SELECT DISTINCT doc_id, i FROM v SEMI JOIN r USING (v)
), s AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM h
), g AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS isle FROM s
)
SELECT doc_id, min(i) AS first_word, max(i) + 50 AS end_word FROM g GROUP BY doc_id, isle""",
    "op4_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents
), s AS (
  SELECT *, trim(translate(line, chr(9) || chr(13) || chr(12) || chr(11), '    ')) AS x FROM l
), k AS (
  SELECT *, x = '' OR row_number() OVER (PARTITION BY x ORDER BY doc_id, no) = 1 AS stays FROM s
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE stays), '') AS text,
       CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (WHERE NOT stays) AS INTEGER) AS n_removed
FROM k GROUP BY doc_id""",
    "op7_exact_top_k": """
WITH e AS (
  SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_sum(list_transform(embedding, lambda v: abs(v))) > 0 GROUP BY vec_id
), p AS (
  SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.x, b.x), 6) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour) AS INTEGER) AS rank FROM p
)
SELECT vec_id, neighbour, rank, score FROM r WHERE rank <= 10""",
    "op10_ngram_jaccard": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(translate(text, '{_UPPER}', '{_LOWER}'), '[^a-z0-9\x80-\x{{10FFFF}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL
), g AS (
  SELECT doc_id, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS g
  FROM w WHERE len(w) > 0
), f AS (SELECT min(doc_id) AS id, count(*) AS copies, g FROM g GROUP BY g),
e AS (SELECT id, len(g) AS n, unnest(g) AS x FROM f),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS c, any_value(a.n + b.n) AS n FROM e a JOIN e b ON a.x = b.x AND a.id <> b.id GROUP BY 1, 2),
p AS (SELECT a, b FROM c WHERE CAST(c AS DOUBLE) / (n - c) >= 0.5),
r AS (SELECT id, id AS root FROM f UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id),
k AS (SELECT id, min(root) AS class_id FROM r GROUP BY id),
l AS (SELECT a AS id, count(*) AS n_links FROM p GROUP BY a)
SELECT g.doc_id, k.class_id, coalesce(l.n_links, 0) AS n_links, f.copies - 1 AS n_copies
FROM g JOIN f ON g.g = f.g JOIN k ON k.id = f.id LEFT JOIN l ON l.id = f.id WHERE f.copies > 1 OR l.n_links > 0""",
}
