"""DuckDB SQL for the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"


def lowered(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


OP7 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id),
l0 AS (SELECT doc_id, host, k, ls[k] AS line, regexp_extract_all(ls[k], '{_WORD}') AS lw
       FROM (SELECT doc_id, host, ls, unnest(range(1, len(ls) + 1)) AS k
             FROM (SELECT doc_id, host, string_split(text, chr(10)) AS ls FROM d))),
l1 AS (SELECT doc_id, host, k, line, len(lw) AS words, {lowered("array_to_string(lw, ' ')")} AS norm FROM l0 WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l1 GROUP BY doc_id),
l3 AS (SELECT doc_id, host, norm, sum(words) AS words FROM l1 GROUP BY ALL),
sets AS (SELECT doc_id, list(norm ORDER BY norm) AS lines FROM l3 GROUP BY doc_id),
often AS (SELECT host, norm FROM l3 JOIN sets USING (doc_id) GROUP BY ALL HAVING count(DISTINCT lines) > 30),
lost AS (SELECT doc_id, sum(words) AS lost, count(*) AS n FROM l3 JOIN often USING (host, norm) GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
             coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
             coalesce(lost.n, 0) AS n_boilerplate_lines, coalesce(lost.lost, 0)::BIGINT AS n_boilerplate_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_boilerplate_words) >= 30 * n_words AS kept
FROM b
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({lowered("coalesce(text, '')")}, '{_ALNUM}') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({lowered("coalesce(text, '')")}, '{_ALNUM}') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(ws[k:k + 12], ' ') AS win, least(len(ws), 13) AS size
       FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS k FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, k, array_to_string(ws[k:k + size - 1], ' ') AS win
       FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM d, sizes WHERE len(ws) >= size)),
m AS (SELECT doc_id, k, dw.size, item FROM dw JOIN bw USING (win, size)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP10 = r"""
WITH l0 AS (SELECT doc_id, k, trim(ls[k], ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line
            FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
l AS (SELECT * FROM l0 WHERE line <> ''),
f AS (SELECT line, min({'d': doc_id, 'k': k}) AS p, length(line) AS size FROM l GROUP BY line),
e AS (SELECT a.p AS a, b.p AS b FROM f AS a JOIN f AS b ON b.size BETWEEN a.size - 2 AND a.size + 2 AND a.p < b.p
      WHERE a.size >= 12 AND b.size >= 12 AND abs(strlen(a.line) - strlen(b.line)) <= 8
        AND (substr(a.line, 1, a.size // 3) = substr(b.line, 1, a.size // 3)
             OR a.line[-(a.size // 3):] = b.line[-(a.size // 3):]
             OR contains(b.line, substr(a.line, a.size // 3 + 1, a.size // 3)))
        AND levenshtein(a.line, b.line) <= 2),
n AS (SELECT p, count(*) AS n_links, max(later) AS later FROM (SELECT a AS p, 0 AS later FROM e UNION ALL SELECT b, 1 FROM e) GROUP BY p),
g AS (SELECT f.p.d AS doc_id, count(*) AS n_first, sum(coalesce(later, 0))::BIGINT AS n_near, sum(coalesce(n_links, 0))::BIGINT AS n_links,
             sum(CASE WHEN coalesce(later, 0) = 0 THEN size ELSE 0 END)::BIGINT AS kept_chars
      FROM f LEFT JOIN n ON f.p = n.p GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_first, 0) AS n_first, coalesce(n_near, 0) AS n_near,
       coalesce(n_first, 0) - coalesce(n_near, 0) AS n_kept, coalesce(n_links, 0) AS n_links, coalesce(kept_chars, 0) AS kept_chars
FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN g USING (doc_id)
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all({lowered("text")}, '{_TERM}')) AS term FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all({lowered("text")}, '{_TERM}')) AS term FROM benchmark),
iq AS (SELECT q, item_id, term, count(*) AS times FROM i GROUP BY ALL),
sizes AS (SELECT row, count(*) AS n FROM d GROUP BY row),
total AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nl FROM sizes),
m AS (SELECT row, 100 - 75 + ((75 * n * nd) // nl) AS m FROM sizes, total),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM iq) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
s AS (SELECT q, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM iq JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""

ORACLE = {
    "op13_ranked_search": OP13,
    "op10_line_dedup": OP10,
    "op2_decontamination": OP2,
    "op7_quality_rules": OP7,
}
