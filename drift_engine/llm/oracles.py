"""DuckDB text for the operators that SQL can express."""

from __future__ import annotations

import string

ORACLES = {
    "op8_near_hyperminhash": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS v, doc_id AS w FROM documents UNION SELECT r.v, l.b FROM reach r JOIN l ON l.a = r.w)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.least AS component_id, d.doc_id = r.least AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(w) AS least FROM reach GROUP BY v) r ON r.v = d.doc_id""",
    "op6_mix_waterfill": r"""WITH sz AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5('20:' || doc_id), 1, 15))::BIGINT AS place FROM documents),
grouped AS (SELECT source, sum(size)::BIGINT AS source_size FROM sz GROUP BY source),
src AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight FROM grouped),
steps AS (SELECT cap / weight AS ratio, (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM src) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM src),
lev AS (SELECT coalesce(arg_min(level, ratio) FILTER (WHERE level <= ratio), max(ratio)) AS level FROM steps),
goals AS (SELECT source, source_size, least(cap, weight * level) AS target FROM src, lev),
whole AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM goals),
rest AS (SELECT *, floor(target - whole * source_size)::BIGINT AS rest FROM whole),
run AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM sz)
SELECT doc_id, size, source_size, target, (size * whole + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM run JOIN rest ON run.source IS NOT DISTINCT FROM rest.source""",
    "op10_quality_lines": r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, unnest(range(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))) AS k FROM d),
win AS (SELECT rid, k, list(word) OVER eight AS words FROM w WINDOW eight AS (PARTITION BY rid ORDER BY k ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (SELECT rid, k, count(*) OVER (PARTITION BY rid, words) AS found FROM win WHERE len(words) = 8),
rep AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT rid, unnest(range(k, k + 8)) AS p FROM twice WHERE found > 1) GROUP BY rid),
raw AS (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT rid, source, text, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS plain, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM l GROUP BY rid),
hosts AS (SELECT source, greatest(10::DOUBLE, 0.002::DOUBLE * count(*)) AS most FROM d GROUP BY source),
often AS (SELECT x.source, x.plain FROM (SELECT source, plain, count(DISTINCT text) AS spread FROM l GROUP BY source, plain) x JOIN hosts h ON x.source IS NOT DISTINCT FROM h.source WHERE x.spread > h.most),
gone AS (SELECT l.rid, sum(l.words)::BIGINT AS removed_words, count(*)::BIGINT AS removed_lines FROM l JOIN often o ON o.plain = l.plain AND o.source IS NOT DISTINCT FROM l.source GROUP BY l.rid),
f AS (SELECT d.rid, d.doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words, coalesce(removed_lines, 0) AS removed_lines
FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, removed_lines, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT removed_words > 0.5 * n_words AS kept FROM f""",
    "op11_exact_block_names": r"""WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size, row_number() OVER same = 1 AS kept, sha256(plain) AS text_sha256
FROM n WINDOW same AS (PARTITION BY plain ORDER BY n_chars DESC, doc_id)""",
    "op12_search_maxscore": rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT iid, item_id, term FROM (SELECT row_number() OVER () AS iid, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
lens AS (SELECT rid, count(*)::BIGINT AS n FROM d GROUP BY rid),
sums AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM lens),
tf AS (SELECT rid, doc_id, term, count(*)::BIGINT AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY rid, doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, sums GROUP BY term, nn),
s AS (SELECT q.iid, q.item_id, tf.rid, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * lens.n * sums.nn) // sums.ll))))::BIGINT AS score
FROM q JOIN tf USING (term) JOIN w USING (term) JOIN lens ON lens.rid = tf.rid, sums GROUP BY q.iid, q.item_id, tf.rid, tf.doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
}
