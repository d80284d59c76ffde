"""The operators' queries over their whole tables, with SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import (
    conversation_repair,
    decontaminate,
    html_extract,
    language_id,
    line_dedup,
    near_dedup,
    packing,
    resampling,
    secret_scan,
    substring_dedup,
    token_counts,
    top_k,
    url_filters,
)
from skyloom.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Fixed rules of the query: host, path, verdict.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_decontaminate")
def op1(spark, sf_dir):
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op2_html_extract")
def op2(spark, sf_dir):
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


@query("op3_pack")
def op3(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"))


# A word run is a window if dropping its last (or first) line leaves too few words.
LINE_SQL = """
WITH lines AS (
    SELECT doc_id, i - 1 AS i, l, len(list_filter(regexp_split_to_array(l, '\\s+'), lambda x: x <> '')) AS n,
           array_to_string(list_filter(regexp_split_to_array(lower(l), '\\s+'), lambda x: x <> ''), ' ') AS h
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
                 unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
          FROM documents WHERE text IS NOT NULL)
), worded AS (
    SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto,
           row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE n > 0
), windows AS (
    SELECT a.doc_id, a.i AS f, b.i AS t, a.k AS fk, b.k AS tk
    FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.n >= 50
     AND (b.upto - b.n - a.upto + a.n < 50 OR b.upto - a.upto < 50)
), filled AS (
    SELECT w.doc_id, f, t, string_agg(x.h, chr(10) ORDER BY x.k) AS content
    FROM windows w JOIN worded x ON x.doc_id = w.doc_id AND x.k BETWEEN fk AND tk GROUP BY w.doc_id, f, t
), later AS (
    SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, f, t) AS nth FROM filled
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(f, t + 1)) AS i FROM later WHERE nth > 1
), kept AS (
    SELECT l.doc_id, string_agg(CASE WHEN g.i IS NULL THEN l.l END, chr(10) ORDER BY l.i) AS text, count(g.i) AS gone
    FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(k.gone, 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


@query("op4_line_dedup", LINE_SQL)
def op4(spark, sf_dir):
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


NEAR_SQL = """
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), shingled AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
links AS (
    SELECT a, b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
        FROM shingled x JOIN shingled y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
    JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
    SELECT doc_id, doc_id AS r FROM words UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc_id
), least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, l.component_id = w.doc_id AS kept
FROM words w JOIN least l USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""


@query("op5_near_duplicates", NEAR_SQL)
def op5(spark, sf_dir):
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85)


@query("op6_secret_scan")
def op6(spark, sf_dir):
    return secret_scan.scan(read(spark, sf_dir, "documents"))


@query("op7_language_id")
def op7(spark, sf_dir):
    return language_id.identify(read(spark, sf_dir, "documents"))


@query("op8_token_counts")
def op8(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


URL_SQL = """
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), urls AS (
    SELECT row_number() OVER () AS row, page_id,
           translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), fits AS (
    SELECT u.row, r.host || r.path AS rule, r.verdict,
           row_number() OVER (PARTITION BY u.row ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS nth
    FROM urls u JOIN rules r ON (u.host = r.host OR u.host LIKE '%.' || r.host) AND starts_with(u.path, r.path)
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON f.row = u.row AND f.nth = 1
"""


@query("op9_url_filters", URL_SQL)
def op9(spark, sf_dir):
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filters.judge_urls(read(spark, sf_dir, "pages"), rules)


TOP_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
    FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query("op10_top_k", TOP_SQL)
def op10(spark, sf_dir):
    return top_k.top_k(read(spark, sf_dir, "embeddings"), k=20, every=20)


# Checksum table, and the checksum of a list of bytes by it.
CRC_TABLE = """crc_table AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) r(i))
)"""
CRC = """xor(list_reduce([4294967295] || {bytes}, lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)"""

# A row's cheapest (cost, edits, text) for each of the four states; equal costs go by the edits.
REPAIR_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, numbered AS (
    SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                          lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
    FROM conversations
), kinds AS (
    SELECT n.*, {CRC.format(bytes="bytes")} % 20 AS kind FROM numbered n, crc_table
), damaged AS (
    SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM kinds
), placed AS (
    SELECT *, row_number() OVER w AS i, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before,
           row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
           rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
    FROM damaged WINDOW w AS (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(len(role) || ':' || role || text), copy)
), faults AS (
    SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                   WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
           before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au') AS illegal
    FROM placed
), steps AS (
    SELECT g, i, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' ELSE initial END AS c,
           CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra, role, text FROM faults
), costs AS (
    SELECT g, CAST(0 AS BIGINT) AS i, {{'c': 0, 'e': '', 't': ''}} AS n, {{'c': 1000000, 'e': '', 't': ''}} AS s,
           {{'c': 5, 'e': 'I', 't': chr(10) || 'user:'}} AS u,
           {{'c': 10, 'e': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS a
    FROM (SELECT DISTINCT g FROM numbered)
    UNION ALL
    SELECT g, i, n, s, u, list_sort([a, {{'c': u.c + 5, 'e': u.e || 'I', 't': u.t || chr(10) || 'assistant:'}}])[1] AS a
    FROM (
        SELECT g, i, n, s, a, list_sort([u] || list_transform([n, s, a], lambda x:
                   {{'c': x.c + 5, 'e': x.e || 'I', 't': x.t || chr(10) || 'user:'}}))[1] AS u
        FROM (
            SELECT b.g, p.i,
                   {{'c': n.c + 2, 'e': n.e || 'D', 't': n.t}} AS n,
                   list_sort([{{'c': s.c + 2, 'e': s.e || 'D', 't': s.t}}] || CASE WHEN p.c = 's' THEN
                       [{{'c': n.c + extra, 'e': n.e || 'K', 't': n.t || chr(10) || role || ':' || text}}] ELSE [] END)[1] AS s,
                   list_sort([{{'c': u.c + 2, 'e': u.e || 'D', 't': u.t}}] || CASE WHEN p.c = 'u' THEN
                       list_transform([n, s, a], lambda x: {{'c': x.c + extra, 'e': x.e || 'K', 't': x.t || chr(10) || role || ':' || text}}) ELSE [] END
                       || CASE WHEN p.c <> 'x' THEN
                       list_transform([n, s, a], lambda x: {{'c': x.c + 1 + extra, 'e': x.e || 'R', 't': x.t || chr(10) || 'user:' || text}}) ELSE [] END)[1] AS u,
                   list_sort([{{'c': a.c + 2, 'e': a.e || 'D', 't': a.t}}] || CASE WHEN p.c = 'a' THEN
                       [{{'c': u.c + extra, 'e': u.e || 'K', 't': u.t || chr(10) || role || ':' || text}}] ELSE [] END
                       || CASE WHEN p.c <> 'x' THEN
                       [{{'c': u.c + 1 + extra, 'e': u.e || 'R', 't': u.t || chr(10) || 'assistant:' || text}}] ELSE [] END)[1] AS a
            FROM costs b JOIN steps p ON p.g = b.g AND p.i = b.i + 1))
), best AS (
    SELECT g, list_sort([n, a])[1] AS b FROM costs c WHERE i = (SELECT coalesce(max(i), 0) FROM steps s WHERE s.g = c.g)
), counts AS (
    SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
           count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(illegal) AS illegal
    FROM faults GROUP BY g
)
SELECT k.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(f.blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(f.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(f.truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(f.illegal, 0) AS BIGINT) AS illegal, CAST(b.c AS BIGINT) AS cost, b.e AS audit,
       sha256(substr(b.t, 2)) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM numbered) k JOIN best USING (g) LEFT JOIN counts f USING (g)
"""


@query("op11_conversation_repair", REPAIR_SQL)
def op11(spark, sf_dir):
    return conversation_repair.repair_report(read(spark, sf_dir, "conversations"))


SUBSTRING_SQL = """
WITH words AS (
    SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), placed AS (SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
windows AS (
    SELECT row, i, sha256(array_to_string(w[i:i + 34], ' ')) AS s
    FROM (SELECT row, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)
), again AS (
    SELECT row, i FROM windows JOIN (SELECT s FROM windows GROUP BY s HAVING count(*) > 1) USING (s)
), covered AS (
    SELECT p.row, p.i, word, coalesce(max(a.i) OVER (PARTITION BY p.row ORDER BY p.i) >= p.i - 34, false) AS gone
    FROM placed p LEFT JOIN again a ON a.row = p.row AND a.i = p.i
), kept AS (
    SELECT row, count(*) AS n, count_if(gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS t
    FROM covered GROUP BY row
)
SELECT doc_id, coalesce(n, 0) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (row)
"""


@query("op12_substring_dedup", SUBSTRING_SQL)
def op12(spark, sf_dir):
    kept = substring_dedup.dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


RESAMPLE_SQL = f"""
WITH {CRC_TABLE}, words AS (
    SELECT row, doc_id, item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM (SELECT row_number() OVER () AS row, doc_id, false AS item, text FROM documents
          UNION ALL SELECT NULL, NULL, true, text FROM benchmark)
), features AS (
    SELECT row, item, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words
), hex AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
bytes AS (SELECT f, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM hex),
buckets AS (SELECT f, {CRC.format(bytes="bytes")} % 10000 AS bucket FROM bytes, crc_table),
counts AS (
    SELECT bucket, count_if(NOT item) AS s, count_if(item) AS t, sum(count_if(NOT item)) OVER () AS all_s, sum(count_if(item)) OVER () AS all_t
    FROM features JOIN buckets USING (f) GROUP BY bucket
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
    FROM counts
), means AS (
    SELECT row, count(*) AS n, sum(gain) AS total FROM features JOIN buckets USING (f) JOIN gains USING (bucket) WHERE NOT item GROUP BY row
), weighed AS (
    SELECT doc_id, len(w) AS n_words, coalesce(m.n, 0) AS n_features,
           CAST(CASE WHEN m.n IS NULL THEN 0 WHEN total >= 0 THEN total // m.n ELSE -((-total + m.n - 1) // m.n) END AS BIGINT) AS weight,
           CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
    FROM words LEFT JOIN means m USING (row) WHERE NOT item
), scores AS (
    SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM weighed
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place,
           count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM ranked
"""


@query("op13_importance_resample", RESAMPLE_SQL)
def op13(spark, sf_dir):
    ranks = resampling.resampling_ranks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return ranks.select("doc_id", "n_features", "weight", "score", "rank")
