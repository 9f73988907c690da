"""DuckDB SQL for the queries that SQL can express. Learned, seeded and structural results have none."""

from __future__ import annotations

from lineora.llm.repetition import DUPLICATED, LEAST_WORDS, LINE_CHARS, LINES, TOP


#: kind, pattern, group and least length of each kind of secret, the base kinds first.
_KINDS = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)


def _spans_sql() -> str:
    """For each kind the pieces between matches and the matches give every match's place."""
    parts = []
    for i, (kind, pattern, group, _) in enumerate(_KINDS):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""SELECT doc_id, '{kind}' AS kind, {i} AS place, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
            's': coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0), 'n': length(m[i]), 'g': length(g[i])}})) AS x
        FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS g, regexp_split_to_array(t, {p}) AS b FROM d) WHERE len(m) > 0""")
    least = " ".join(f"WHEN '{kind}' THEN {n}" for kind, _, _, n in _KINDS)
    return f"SELECT doc_id, kind, place, CAST(x.s AS BIGINT) AS s, CAST(x.s + x.n AS BIGINT) AS e FROM ({' UNION ALL '.join(parts)}) WHERE x.g >= CASE kind {least} END"


_OP1 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({_spans_sql()}),
g AS (SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP5 = f"""WITH d AS (SELECT doc_id, {_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) l WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, x)),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, range(0, 10) s(j) WHERE j < n GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR)) FILTER (item_id IS NOT NULL)), ',') AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

_OP6 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a"""

# The CRC-32 of a text by a table of 256 entries; a splitter lies at the row boundary nearest to its share of all bytes.
_OP3 = r"""WITH entries AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([CAST(i AS UBIGINT)] || [CAST(0 AS UBIGINT) FOR x IN range(8)], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS UBIGINT), c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
d AS MATERIALIZED (SELECT doc_id, CAST('0x' || substr(md5(t), 1, 15) AS BIGINT) AS h, CAST(octet_length(encode(t)) + 8 AS BIGINT) AS size, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS UBIGINT)) AS b FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
c AS (SELECT doc_id, h, size, CAST(xor(CAST(4294967295 AS UBIGINT), list_reduce([CAST(4294967295 AS UBIGINT)] || b, lambda c, x: xor(c >> 8, entries.t[1 + CAST(xor(c, x) & 255 AS BIGINT)]))) AS BIGINT) AS text_crc32 FROM d, entries),
k AS (SELECT *, CAST(sum(s) OVER (ORDER BY h, doc_id NULLS FIRST) AS BIGINT) AS hi, CAST(sum(s) OVER () AS BIGINT) AS total FROM (SELECT h, doc_id, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY ALL)),
ends AS (SELECT list(CASE WHEN goal - (hi - s) <= hi - goal THEN hi - s ELSE hi END) AS x FROM (SELECT *, total * i / 24 AS goal FROM k, range(1, 24) r(i)) WHERE hi - s <= goal AND goal < hi),
p AS (SELECT h, doc_id, CAST(len(list_filter(ends.x, lambda e: e <= hi - s)) AS INTEGER) AS shard FROM k, ends)
SELECT c.doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY c.h, c.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM c JOIN p ON c.h = p.h AND c.doc_id IS NOT DISTINCT FROM p.doc_id"""

_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * i + 1}, 5) AS INTEGER) >> {15 - 5 * j}) & 31), 1)" for i in range(8) for j in range(4))
_OP7 = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages), q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest, CASE WHEN page_id = least_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least_id THEN least_id END AS refers_to FROM q"""

_LIMITS = ", ".join([*(f"('top', {n}, {x})" for n, x in TOP.items()), *(f"('dup', {n}, {x})" for n, x in DUPLICATED.items())])
_LEADS = ", ".join(f"lead(x, {j}) OVER o AS w{j}" if j else "x AS w0" for j in range(max(DUPLICATED)))
_GRAMS = " UNION ALL ".join(f"SELECT doc_id, {n} AS n, i, hash({', '.join(f'w{j}' for j in range(n))}) AS x FROM a WHERE w{n - 1} IS NOT NULL" for n in range(2, max(DUPLICATED) + 1))
_OP4 = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, x, length(x) AS c FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w)),
a AS (SELECT doc_id, i, {_LEADS} FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS ({_GRAMS}),
m AS (SELECT doc_id, n, x, count(*) AS k, min(i) AS f FROM g GROUP BY doc_id, n, x HAVING count(*) > 1),
k AS (SELECT g.*, m.k FROM g JOIN m USING (doc_id, n, x)),
best AS (SELECT doc_id, n, arg_max(x, k * 1000000000 - f) AS x FROM m GROUP BY doc_id, n),
hit AS (SELECT 'base' AS kind, doc_id, n, i FROM k WHERE n = 3 AND k > 1 UNION ALL SELECT 'dup', doc_id, n, i FROM k WHERE n >= {min(DUPLICATED)} AND k > 1 UNION ALL SELECT 'top', doc_id, n, i FROM k JOIN best USING (doc_id, n, x) WHERE n <= {max(TOP)}),
cov AS (SELECT DISTINCT kind, doc_id, n, i + j AS i FROM hit, range(0, {max(DUPLICATED)}) q(j) WHERE j < n),
inside AS (SELECT kind, doc_id, n, count(*) AS words, sum(c) AS chars FROM cov JOIN p USING (doc_id, i) GROUP BY ALL),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM w),
lines AS (SELECT doc_id, count(*) AS n, sum(CAST(r > 1 AS INTEGER)) AS dup, sum(CASE WHEN r > 1 THEN length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) ELSE 0 END) AS dup_chars
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, l ORDER BY i) AS r FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]')) GROUP BY doc_id),
base AS (SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
    coalesce(words, 0) AS n_repeat_words, coalesce(dup, 0) / greatest(coalesce(lines.n, 0), 1) > {LINES} OR coalesce(dup_chars, 0) / greatest(word_chars, 1) > {LINE_CHARS} AS bad_lines FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN (SELECT doc_id, words FROM inside WHERE kind = 'base') USING (doc_id)),
over AS (SELECT DISTINCT doc_id FROM inside JOIN (VALUES {_LIMITS}) v(kind, n, most) USING (kind, n) JOIN base USING (doc_id) WHERE inside.chars / word_chars > most),
said AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    base_failed, NOT base_failed AND NOT bad_lines AND doc_id NOT IN (SELECT doc_id FROM over) AS kept FROM said"""



def _op2_sql() -> str:
    """The model in SQL: counts, continuation counts, discounts, and the sum of each document's weights."""
    y = "CASE WHEN n1 = 0 THEN 0.5 ELSE n1 / (n1 + 2 * n2) END"
    d = ", ".join(f"CASE WHEN n{i} = 0 THEN {i / 2} ELSE least(greatest({i} - {i + 1} * ({y}) * n{i + 1} / n{i}, 0.05), {i - 1 + 0.95}) END AS d{i}" for i in (1, 2, 3))
    of = lambda t: f"SELECT m, {d} FROM (SELECT m, CAST(count(*) FILTER (n = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (n = 2) AS DOUBLE) AS n2, CAST(count(*) FILTER (n = 3) AS DOUBLE) AS n3, CAST(count(*) FILTER (n = 4) AS DOUBLE) AS n4 FROM {t} GROUP BY m)"
    totals = lambda t, o, keys: f"SELECT m, {keys}c, k, d1 * n1 + d2 * n2 + d3 * n3 AS s FROM (SELECT m, {keys}CAST(sum(n) AS BIGINT) AS c, count(*) AS k, count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2, count(*) FILTER (n > 2) AS n3 FROM {t} GROUP BY ALL) JOIN {o} USING (m)"
    lost = "CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END"
    units = lambda x: f"CAST(round(({x}) * 1048576) AS BIGINT)"
    return rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS x, substr(md5(text), 1, 1) IN ('0', '1', '2') AS held FROM documents),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0), bad AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
own AS (SELECT lang, x FROM d SEMI JOIN good USING (doc_id) WHERE NOT held AND len(x) > 0),
docs AS MATERIALIZED (SELECT r, doc_id, lang, held, len(x) + 1 AS tokens, CASE WHEN lang IN (SELECT lang FROM own WHERE lang IS NOT NULL) THEN 'l' || lang ELSE 'all' END AS m, ['<s> ', '<s> '] || x || ['</s> '] AS f FROM d),
framed AS (SELECT m, ['<s> ', '<s> '] || x || ['</s> '] AS f FROM (SELECT 'l' || lang AS m, x FROM own WHERE lang IS NOT NULL UNION ALL SELECT 'all', x FROM own)),
c3 AS MATERIALIZED (SELECT m, u, v, w, count(*) AS n FROM (SELECT m, unnest(f[1:len(f) - 2]) AS u, unnest(f[2:len(f) - 1]) AS v, unnest(f[3:]) AS w FROM framed) GROUP BY ALL),
c2 AS MATERIALIZED (SELECT m, v, w, count(*) AS n FROM c3 GROUP BY ALL), c1 AS MATERIALIZED (SELECT m, w, count(*) AS n FROM c2 GROUP BY ALL),
o3 AS ({of("c3")}), o2 AS ({of("c2")}), o1 AS ({of("c1")}),
g3 AS MATERIALIZED (SELECT c3.*, {lost} AS d FROM c3 JOIN o3 USING (m)), g2 AS MATERIALIZED (SELECT c2.*, {lost} AS d FROM c2 JOIN o2 USING (m)), g1 AS MATERIALIZED (SELECT c1.*, {lost} AS d FROM c1 JOIN o1 USING (m)),
s3 AS MATERIALIZED ({totals("c3", "o3", "u, v, ")}), s2 AS MATERIALIZED ({totals("c2", "o2", "v, ")}), s1 AS (SELECT m, c, s / c / (k + 1) AS unseen FROM ({totals("c1", "o1", "")})),
p1 AS MATERIALIZED (SELECT m, w, (n - d) / c + unseen AS p1 FROM g1 JOIN s1 USING (m)),
p2 AS MATERIALIZED (SELECT m, v, w, s / c AS rest, p1, 1 + (n - d) / (s * p1) AS more FROM g2 JOIN s2 USING (m, v) JOIN p1 USING (m, w)),
p3 AS (SELECT m, u, v, w, 1 + (n - d) / (s * (p1 * rest * more)) AS more FROM g3 JOIN s3 USING (m, u, v) JOIN p2 USING (m, v, w)),
weights AS (SELECT m, w AS k, {units("ln(p1)")} AS weight, 1 AS known FROM p1 UNION ALL SELECT m, v, {units("ln(s / c)")}, 0 FROM s2
    UNION ALL SELECT m, v || chr(9) || w, {units("ln(more)")}, 0 FROM p2 UNION ALL SELECT m, u || chr(9) || v, {units("ln(s / c)")}, 0 FROM s3 UNION ALL SELECT m, u || chr(9) || v || chr(9) || w, {units("ln(more)")}, 0 FROM p3),
w AS MATERIALIZED (SELECT m, k, sum(weight) AS weight, max(known) AS known FROM weights GROUP BY ALL),
grams AS MATERIALIZED (SELECT r, m, unnest(f[2:]) AS k FROM docs WHERE tokens > 1 UNION ALL SELECT r, m, a || chr(9) || b FROM (SELECT r, m, unnest(f[1:len(f) - 1]) AS a, unnest(f[2:]) AS b FROM docs WHERE tokens > 1)
    UNION ALL SELECT r, m, a || chr(9) || b || chr(9) || c FROM (SELECT r, m, unnest(f[1:len(f) - 2]) AS a, unnest(f[2:len(f) - 1]) AS b, unnest(f[3:]) AS c FROM docs WHERE tokens > 1)),
sums AS (SELECT r, CAST(sum(weight) AS DOUBLE) AS x, CAST(sum(known) AS DOUBLE) AS seen FROM grams JOIN w USING (m, k) GROUP BY r),
scored AS MATERIALIZED (SELECT docs.*, CASE WHEN tokens > 1 THEN round(exp(-(x + (tokens - seen) * {units("ln(unseen)")}) / 1048576 / tokens), 4) END AS p FROM docs LEFT JOIN sums USING (r) LEFT JOIN s1 USING (m)),
judged AS (SELECT lang, p, 1 AS good FROM scored SEMI JOIN good USING (doc_id) WHERE held AND p IS NOT NULL UNION ALL SELECT lang, p, 0 FROM scored SEMI JOIN bad USING (doc_id) WHERE p IS NOT NULL),
ranked AS (SELECT *, 'own' AS scope, row_number() OVER (PARTITION BY lang, good ORDER BY p) AS i, count(*) OVER (PARTITION BY lang, good) AS n FROM judged
    UNION ALL SELECT NULL, p, good, 'pooled', row_number() OVER (PARTITION BY good ORDER BY p), count(*) OVER (PARTITION BY good) FROM judged),
q AS (SELECT scope, lang, min(p) FILTER (good = 1 AND i >= 0.99 * n) AS g, min(p) FILTER (good = 0 AND i >= 0.05 * n) AS b FROM ranked GROUP BY ALL),
limits AS (SELECT scope, lang, round(CASE WHEN b > g THEN sqrt(g * b) ELSE g END, 4) AS x FROM q)
SELECT doc_id, scored.lang, p AS perplexity, coalesce(l.x, a.x) AS threshold, p IS NOT NULL AND coalesce(p <= coalesce(l.x, a.x), true) AS kept
FROM scored LEFT JOIN limits l ON l.scope = 'own' AND l.lang = scored.lang LEFT JOIN limits a ON a.scope = 'pooled'"""


ORACLES: dict[str, str] = {"op3_histogram_sort": _OP3, "op2_kneser_ney": _op2_sql(), "op4_repetition": _OP4, "op1_blob_ledger": _OP1, "op5_decontaminate": _OP5, "op6_jaccard_join": _OP6, "op7_warc": _OP7}
