"""The queries of the thirteen operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import digest_merge, dual_tree, html_extract, huffman, importance, licences, mixing, order_minhash, packing, quality_rules, url_lm, vector_graph, whitening
from .base import table


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.apply(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.apply(table(spark, sf_dir, "documents"), tokenizer())


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.apply(table(spark, sf_dir, "pages"))


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.apply(table(spark, sf_dir, "embeddings"))


def op7_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.apply(table(spark, sf_dir, "documents"), tokenizer())


def op8_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.apply(table(spark, sf_dir, "pages"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of the tree source/lang. Those of up to NOTICE_LINES lines with a licence term stand for licence files."""
    docs = table(spark, sf_dir, "documents")
    notice = (F.size(F.split("text", "\n", NOTICE_LINES + 1)) <= NOTICE_LINES) & F.col("text").rlike(licences.HINT)
    name = F.when(F.coalesce(notice, F.lit(False)), F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    files = docs.select("doc_id", F.concat_ws("/", "source", "lang", name).alias("path"), "text")
    return licences.apply(files, id="doc_id")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.apply(table(spark, sf_dir, "documents"))


def op11_digest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_merge.apply(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.apply(table(spark, sf_dir, "embeddings"))


def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.apply(table(spark, sf_dir, "embeddings"))


NOTICE_LINES = 3


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_balanced_mix, op2_best_fit_packing, op3_line_rules, op4_tag_paths, op5_importance, op6_vector_graph, op7_huffman, op8_url_models, op9_licences, op10_order_minhash,
        op11_digest_merge, op12_whitening, op13_dual_tree,
    )}


_W, _BLANK = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _rules_sql() -> str:
    q = quality_rules
    phrases = " OR ".join(f"contains(lower(line), {_text(p)})" for p in q.BOILERPLATE)
    count = lambda pattern: f"len(regexp_extract_all(line, {_text(pattern)}))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '{_W}') AS w FROM d),
k AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 3)),
c AS (SELECT doc_id, x FROM k GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat FROM k JOIN c USING (doc_id, x), (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
s AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
l AS (SELECT doc_id, i, line, {count(_W)} AS n, length(regexp_replace(line, '{_BLANK}', '', 'g')) AS chars, {count(q.SYMBOLS)} AS symbols, {count("[|]")} AS bars, {count(q.BULLETS)} AS bullets, {count(q.LINK)} AS links,
  len(regexp_extract_all(line, '!!(?:[\\x20\\x09-\\x0D]|$)')) AS shouted FROM s),
e AS (SELECT *, n BETWEEN 1 AND {q.MENU_WORDS} AND NOT contains({_text(q.ENDS)}, right(rtrim(line, {_text(q.BLANK)}), 1)) AS entry FROM l),
f AS (SELECT *, sum(entry::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS {q.MENU_RUN - 1} PRECEDING) AS before, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS copy FROM e),
b AS (SELECT *, n > 0 AND (symbols * 100 > n * {q.MAX_SYMBOL_PERCENT} OR (bars >= {q.MENU_BARS} AND bars * 3 >= n) OR (bullets >= {q.MENU_BULLETS} AND bullets * 3 >= n) OR (links > 0 AND links * 100 >= n * {q.MAX_LINK_PERCENT})
  OR (contains(line, '!!') AND shouted * 100 >= n * {q.MAX_SHOUT_PERCENT}) OR (n <= {q.BOILER_WORDS} AND ({phrases})) OR copy > {q.COPIES}
  OR (entry AND max(before) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {q.MENU_RUN - 1} FOLLOWING) = {q.MENU_RUN})) AS bad FROM f),
g AS (SELECT doc_id, coalesce(sum(chars) FILTER (bad), 0) AS lost, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines FROM b GROUP BY doc_id),
a AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{_BLANK}', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, lost
  FROM w JOIN g USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost * 100 <= word_chars * {q.MAX_LOST_PERCENT} AS kept FROM a
"""


_VECTORS_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {vector_graph.COSINE}),
reach AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, root FROM reach JOIN l ON l.a = node),
c AS (SELECT node, min(root) AS root FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, vec_id = root AS kept FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""


def _licences_sql() -> str:
    hint, cut = _text(licences.HINT), "chr(1)"
    fixed = ", ".join("({}, {}, {})".format(i, _text(n), _text(t.replace("\n", " "))) for i, (n, t) in enumerate(licences.TEMPLATES))
    marks = ", ".join(f"({_text(n)}, {_text(needed)}, {_text(other)})" for n, (needed, other) in licences.MARKS.items())
    runs = lambda inside: f"string_split(array_to_string(list_transform(lines, lambda x: CASE WHEN regexp_matches(x, {_text(inside)}) THEN x ELSE {cut} END), ' '), {cut})"
    return f"""
WITH d AS (SELECT doc_id, text, source || '/' || lang AS dir, source || '/' || lang || '/' || CASE WHEN len(string_split(text, chr(10))) <= {NOTICE_LINES} AND regexp_matches(text, {hint}) THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END AS path FROM documents),
n AS (SELECT *, string_split(text, chr(10)) AS lines FROM d WHERE regexp_matches(text, {hint})),
s AS (SELECT DISTINCT doc_id, path, trim(segment, ' ') AS segment FROM (SELECT doc_id, path, unnest(list_concat(lines, list_concat({runs(licences.COMMENT)}, {runs(licences.TERM)}))) AS segment FROM n) WHERE regexp_matches(segment, {hint})
  UNION SELECT doc_id, path, trim(text, ' ') FROM n WHERE contains(path, '/LICENSE-')),
t(template, license, text) AS (VALUES {fixed}), x(license, needed, other) AS (VALUES {marks}), u AS (SELECT DISTINCT segment FROM s),
o AS (SELECT segment, term, count(*) AS tf FROM (SELECT segment, unnest(regexp_extract_all(lower(segment), '[a-z0-9]+')) AS term FROM u) GROUP BY ALL),
k AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM t) GROUP BY ALL),
f AS (SELECT term, ln((1 + (SELECT count(*) FROM u) + (SELECT count(*) FROM t))::DOUBLE / (1 + count(*))::DOUBLE) + 1 AS idf FROM (SELECT term FROM o UNION ALL SELECT term FROM k) GROUP BY term),
ow AS (SELECT segment, term, tf * idf AS w FROM o JOIN f USING (term)), kw AS (SELECT template, license, term, tf * idf AS w FROM k JOIN f USING (term)),
q AS (SELECT segment, license, round(sum(ow.w * kw.w) / (any_value(a.n) * any_value(b.n)), 9) AS score FROM ow JOIN kw USING (term) JOIN (SELECT segment, sqrt(sum(w * w)) AS n FROM ow GROUP BY ALL) a USING (segment)
  JOIN (SELECT template, sqrt(sum(w * w)) AS n FROM kw GROUP BY ALL) b USING (template) GROUP BY segment, license, template),
g AS (SELECT q.segment, q.license, q.score, array_to_string(regexp_extract_all(lower(q.segment), '[a-z0-9]+'), ' ') AS words, needed, other FROM q JOIN x USING (license) WHERE score >= {licences.COSINE}),
m AS (SELECT s.doc_id, s.path, g.license, score, row_number() OVER (PARTITION BY s.doc_id ORDER BY score DESC, g.license) AS r FROM s JOIN g USING (segment)
  WHERE regexp_matches(words, needed) AND NOT regexp_matches(words, other) AND NOT regexp_matches(words, {_text(licences.DENIED)})),
own AS (SELECT doc_id, path, license, score FROM m WHERE r = 1),
i AS (SELECT dir, license AS dir_license, row_number() OVER (PARTITION BY dir ORDER BY score DESC, own.path, license) AS r FROM own JOIN d USING (doc_id) WHERE contains(own.path, '/LICENSE-'))
SELECT d.doc_id, d.path, own.license AS own_license, score, CASE WHEN own.license IS NULL THEN dir_license END AS inherited_license, CASE WHEN own.license IS NULL AND dir_license IS NOT NULL THEN d.dir END AS inherited_from, coalesce(own.license, dir_license) AS license
FROM d LEFT JOIN own USING (doc_id) LEFT JOIN (FROM i WHERE r = 1) i ON i.dir = d.dir
"""


_COPIES_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')) AS h FROM documents) WINDOW w AS (PARTITION BY h)
"""


def _clusters_sql() -> str:
    d = dual_tree
    square = "list_sum(list_transform(v.x, lambda e, i: (e - c.x[i]) * (e - c.x[i])))"
    near = lambda r: f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v.x) AS x, min(({square}, k)) AS b FROM v, c{r} c GROUP BY vec_id)"
    rounds = [near(0)]
    for r in range(d.ROUNDS):
        rounds.append(f"s{r} AS (SELECT b[2] AS k, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, {d.DIMS + 1}) t(i) GROUP BY ALL)")
        rounds.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY k) m USING (k))")
        rounds.append(near(r + 1))
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor({d.SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(list_filter(embedding, lambda e: isfinite(e))) = {d.DIMS} AND len(embedding) = {d.DIMS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{d.SALT}' || vec_id)) - 1 AS k, x FROM v QUALIFY k < {d.CENTROIDS}), {", ".join(rounds)}
SELECT vec_id, b[2]::INT AS cluster, b[1]::BIGINT AS distance, (sum(b[1]) OVER (PARTITION BY b[2]))::BIGINT AS cluster_inertia, (sum(b[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{d.ROUNDS} JOIN c{d.ROUNDS} c ON c.k = b[2]
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the whole result; it is slow on large tables for vectors."""
    return {
        "op3_line_rules": _rules_sql(), "op6_vector_graph": _VECTORS_SQL, "op9_licences": _licences_sql(), "op11_digest_merge": _COPIES_SQL, "op13_dual_tree": _clusters_sql(),
    }
