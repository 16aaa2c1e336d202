"""SQL that gives the rows of the queries it can express: all pairs of sets, and payloads as they are."""

from __future__ import annotations

import string


def near_duplicates(width: int, threshold: int, kept: bool) -> str:
    """Sizes and components of word-shingle sets by all pairs that share a shingle, at threshold per cent; kept: whether a document is its component."""
    more = ", doc_id = component_id AS kept" if kept else ""
    return f"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + {width - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS i FROM texts WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT p.a, p.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id) p
    JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * m >= {threshold} * (x.n + y.n - m)
), reached(doc_id, other) AS (
    SELECT a, b FROM links UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
), found AS (
    SELECT t.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, least(t.doc_id, coalesce(min(r.other), t.doc_id)) AS component_id
    FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id LEFT JOIN reached r ON r.doc_id = t.doc_id GROUP BY t.doc_id
)
SELECT doc_id, n_shingles, component_id{more} FROM found"""


_BASE32 = "[" + ", ".join(f"'{c}'" for c in string.ascii_uppercase + "234567") + "]"
#: Five hexadecimal digits are four of base 32.
WARC = f"""
WITH pages_of AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
known AS (SELECT html, min(page_id) AS least FROM pages_of GROUP BY html),
hashed AS (SELECT p.page_id, p.html, k.least, sha1(p.html) AS h FROM pages_of p JOIN known k ON k.html = p.html)
SELECT page_id, (SELECT url FROM pages u WHERE u.page_id = hashed.page_id) AS url, octet_length(encode(html)) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: {_BASE32}[((('0x' || substr(h, k // 4 * 5 + 1, 5))::INTEGER >> (15 - 5 * (k % 4))) & 31) + 1]), '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM hashed"""


#: The checksum of a text's bytes, a byte at a time by the usual table, which the reversed polynomial makes.
_CRC_TABLE = "SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t"
_BYTES = "list_transform(range(0, octet_length(encode(s))), lambda k: ('0x' || substr(hex(encode(s)), 2 * k + 1, 2))::BIGINT)"
_CRC = f"xor(4294967295, list_reduce({_BYTES}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295))"
#: Words by dropping or blanking each letter.
SPELLING = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
runs AS (
    SELECT doc_id, translate(r, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= 6 GROUP BY ALL
), hashed AS (
    SELECT w, c, {_CRC} AS h FROM (SELECT w, c, coalesce(doc_id::VARCHAR, '') || ':' || w AS s FROM runs), crc
), words AS (
    SELECT word, sum(c)::BIGINT AS n FROM (SELECT c, CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), cut AS (
    SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
    SELECT x.word, y.word AS other, y.n AS m FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION SELECT x.word, y.word, y.n FROM cut x JOIN words y ON y.word = x.a || x.b
    UNION SELECT y.word, x.word, x.n FROM cut x JOIN words y ON y.word = x.a || x.b
), best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word
), formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.other END AS form, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word
), walk(word, here) AS (
    SELECT word, word FROM formed UNION ALL SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.here WHERE f.form IS NOT NULL
), ends AS (
    SELECT k.word, k.here AS root FROM walk k JOIN formed f ON f.word = k.here WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""


#: Runs of words from all pairs of equal words of a text: for each distance the stretches of places that go on without a gap.
RUNS = f"""
WITH crc AS ({_CRC_TABLE}),
texts AS (
    SELECT doc_id, w, h, (h // 10) % greatest(len(w), 1) AS a FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, coalesce({_CRC}, 1) AS h FROM (SELECT doc_id, text, doc_id::VARCHAR AS s FROM documents), crc)
), planted AS (
    SELECT doc_id, CASE WHEN h % 10 = 0 THEN list_transform(range(0, len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM texts)
), words AS (
    SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i, len(w) AS n FROM planted
), same AS (
    SELECT a.doc_id, b.i - a.i AS q, a.i FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
), stretches AS (
    SELECT doc_id, q, min(i) AS s, count(*) + q AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same) GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
    SELECT doc_id, s, m, min(q) AS q FROM stretches GROUP BY doc_id, s, m
), said AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS t, first({{'s': s, 'm': m, 'q': q}} ORDER BY m DESC, s, q) AS b FROM runs GROUP BY doc_id
), kept AS (
    SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS c FROM words w WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.s + r.q AND w.i < r.s + r.m) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.m::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.m // b.q)::BIGINT AS exponent_milli, sha256(coalesce(t, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM documents d LEFT JOIN said USING (doc_id) LEFT JOIN kept USING (doc_id)"""
