"""The registered queries of this subpackage: each applies an operator, with its production parameters, to whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, html_wrappers, langid, line_dedup, maxscore, multi_index, packing, prefix_trie, quality, simhash, token_files, toxicity
from .common import shared_dir, table


def op1_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), digest=True)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extracted(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_counts(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tidewake/{spark.sparkContext.applicationId}/coded-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.digest(token_files.table(spark, path))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_maxscore_topk, op2_packing, op3_language, op4_quality, op5_html, op6_line_dedup, op7_toxicity, op8_token_files, op9_decontamination, op10_simhash, op11_prefix_trie, op12_multi_index, op13_hard_negatives)
}

ORACLES: dict[str, str] = {
    "op1_maxscore_topk": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    # a line's words, leaf and template as text instead of hashes
    "op6_line_dedup": r"""
        WITH u AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
        p AS (
            SELECT doc_id, text, string_split(regexp_replace(regexp_replace(text, '(^|[ \t\n\x0B\f\r])[^ \t\n\x0B\f\r0-9]*[0-9][^ \t\n\x0B\f\r]*', '\1<*>', 'g'),
                '[ \t\x0B\f\r]+', ' ', 'g'), chr(10)) AS ls FROM u
        ), l AS (SELECT doc_id, text, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS ln FROM p),
        f AS (
            SELECT doc_id, text, ln, trim(line, ' ') AS words, string_split(trim(line, ' '), ' ') AS ts,
                len(ts) || '|' || array_to_string(ts[1:3], ' ') AS leaf, row_number() OVER (PARTITION BY doc_id, text ORDER BY ln) AS i
            FROM l WHERE trim(line, ' ') <> ''
        ), g AS (SELECT *, lag(leaf) OVER w AS b, lead(leaf) OVER w AS a FROM f WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)),
        busy AS (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT words) > 1 AND count(DISTINCT (doc_id, text)) >= 10),
        kinds AS (SELECT leaf, words, ts, count(*) AS n FROM f WHERE leaf IN (SELECT leaf FROM busy) GROUP BY ALL),
        totals AS (SELECT leaf, sum(n) AS total FROM kinds GROUP BY leaf),
        tokens AS (SELECT leaf, words, n, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM kinds),
        counts AS (
            SELECT leaf, pos, token, sum(n) > 0.5 * any_value(total) AS general FROM tokens JOIN totals USING (leaf)
            GROUP BY leaf, pos, token HAVING sum(n) > 0.5 * any_value(total) OR sum(n) >= 10
        ), marked AS (
            SELECT leaf, words, count(*) AS size, count(*) FILTER (general) AS general, count(general) AS common,
                string_agg(CASE WHEN general IS NULL THEN '<*>' ELSE token END, ' ' ORDER BY pos) AS shown
            FROM tokens LEFT JOIN counts USING (leaf, pos, token) GROUP BY leaf, words
        ), keys AS (
            SELECT leaf, words, CASE WHEN general >= 0.7 * size THEN 'leaf ' || leaf WHEN common >= 0.7 * size THEN 'masked ' || shown ELSE 'own ' || words END AS key FROM marked
        ), keyed AS (SELECT g.*, coalesce(key, 'own ' || g.words) AS key FROM g LEFT JOIN keys USING (leaf, words)),
        candidates AS (SELECT key FROM keyed GROUP BY key HAVING count(DISTINCT (doc_id, text)) >= 10),
        hits AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, text ORDER BY i) AS run FROM keyed WHERE key IN (SELECT key FROM candidates)),
        runs AS (SELECT doc_id, text, run, first(b ORDER BY i) AS b, last(a ORDER BY i) AS a, string_agg(key || '@' || i, '|' ORDER BY i) AS whole, list(DISTINCT key) AS ks FROM hits GROUP BY doc_id, text, run),
        arounds AS (SELECT unnest(ks) AS key, CASE WHEN b IS NULL AND a IS NULL THEN 'whole ' || whole ELSE coalesce(b, '') || '~' || coalesce(a, '') END AS around FROM runs),
        recurring AS (SELECT key FROM arounds GROUP BY key HAVING count(DISTINCT around) >= 10),
        gone AS (SELECT doc_id, text, list(ln) AS ats FROM hits WHERE key IN (SELECT key FROM recurring) GROUP BY doc_id, text),
        kept AS (
            SELECT d.doc_id, d.text, CASE WHEN ats IS NULL THEN d.text ELSE coalesce(array_to_string([x FOR x, i IN string_split(d.text, chr(10)) IF NOT list_contains(ats, i - 1)], chr(10)), '') END AS clean
            FROM documents d LEFT JOIN gone g ON g.doc_id IS NOT DISTINCT FROM d.doc_id AND g.text = d.text
        ), n AS (SELECT *, coalesce(len([x FOR x IN string_split(text, chr(10)) IF trim(x, ' ') <> '']), 0) AS n_lines, coalesce(len([x FOR x IN string_split(clean, chr(10)) IF trim(x, ' ') <> '']), 0) AS n_left FROM kept)
        SELECT doc_id, n_lines, n_lines - n_left AS n_dropped, clean AS text FROM n
    """,
    # crc32 from its polynomial; a node is the list of the digests of its turns
    "op11_prefix_trie": r"""
        WITH RECURSIVE bits AS (
            SELECT i AS n, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
        ), crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
        turns AS (
            SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS g, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n
            FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
        ), own AS (SELECT conv_id, list(g ORDER BY turn NULLS FIRST, g) AS g, list(n ORDER BY turn NULLS FIRST, g) AS n FROM turns GROUP BY conv_id),
        heads AS (
            SELECT own.*, xor(list_reduce([ord(x) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 4 AS h FROM own, crc
        ), made AS (
            SELECT c.conv_id, coalesce(b.g[1:c.h], []) || c.g[c.h + 1:] AS g, coalesce(b.n[1:c.h], []) || c.n[c.h + 1:] AS n FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
        ), each AS (SELECT conv_id, g, n, unnest(range(len(g) + 1)) AS depth FROM made),
        node AS (
            SELECT g[1:depth] AS s, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(n[depth]), 0) AS saved,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(g) = depth), '')) AS ends_sha256 FROM each GROUP BY 1, 2
        ), kids AS (SELECT s[1:depth - 1] AS s, depth - 1 AS depth, count(*) AS k FROM node WHERE depth > 0 GROUP BY 1, 2),
        full_ AS (SELECT node.*, coalesce(k, 0) AS n_children FROM node LEFT JOIN kids USING (s, depth)),
        up AS (SELECT s[1:e] AS s, e AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS e FROM full_) GROUP BY 1, 2)
        SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
        FROM full_ f JOIN up USING (s, depth) LEFT JOIN full_ p ON p.depth = f.depth - 1 AND p.s = f.s[1:f.depth - 1]
    """,
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), n AS (
            SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
            FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
    """,
}
