"""DuckDB SQL for the results of operators that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

OP6 = f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, {_WORDS.format(text="coalesce(text, '')")} w FROM documents),
windows AS (SELECT r, doc_id, s, array_to_string(w[s:s + 49], ' ') t FROM (SELECT *, unnest(range(1, len(w) - 48)) s FROM d WHERE len(w) >= 50)),
least AS (SELECT t, min(doc_id) m FROM windows GROUP BY t),
starts AS (SELECT r, s FROM windows JOIN least USING (t) WHERE doc_id > m),
edges AS (SELECT r, p, sum(v) v FROM (SELECT r, s p, 1 v FROM starts UNION ALL SELECT r, s + 50, -1 FROM starts) GROUP BY r, p),
words AS (SELECT r, p, w[p] word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) p FROM d)),
covered AS (SELECT words.r, words.p, word, coalesce(sum(v) OVER (PARTITION BY words.r ORDER BY words.p), 0) c FROM words LEFT JOIN edges ON edges.r = words.r AND edges.p = words.p),
kept AS (SELECT r, count(*) n, string_agg(word, ' ' ORDER BY p) t FROM covered WHERE c = 0 GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(t, '')) kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

OP7 = """
WITH d AS (SELECT row_number() OVER () r, doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
strings AS (SELECT r, s, md5(substr(h, 2 * s + 1, 400)) t FROM (SELECT *, unnest(range(0, length(h) // 2 - 199)) s FROM d WHERE length(h) >= 400)),
several AS (SELECT t FROM strings GROUP BY t HAVING count(*) > 1),
starts AS (SELECT r, s FROM strings SEMI JOIN several USING (t)),
edges AS (SELECT r, p, sum(v) v FROM (SELECT r, s p, 1 v FROM starts UNION ALL SELECT r, s + 200, -1 FROM starts) GROUP BY r, p),
signs AS (SELECT r, p, substr(h, 2 * p + 1, 2) b FROM (SELECT r, h, unnest(range(0, length(h) // 2)) p FROM d)),
covered AS (SELECT signs.r, signs.p, b, coalesce(sum(v) OVER (PARTITION BY signs.r ORDER BY signs.p), 0) > 0 c FROM signs LEFT JOIN edges ON edges.r = signs.r AND edges.p = signs.p),
marked AS (SELECT *, c AND NOT coalesce(lag(c) OVER (PARTITION BY r ORDER BY p), false) head FROM covered),
kept AS (SELECT r, count(*) FILTER (c) n, count(*) FILTER (head) spans, string_agg(b, '' ORDER BY p) FILTER (NOT c) t FROM marked GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) n_bytes, coalesce(n, 0) n_removed, coalesce(spans, 0) n_spans, sha256(unhex(coalesce(t, ''))) kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () r, doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w FROM documents),
sets AS (SELECT DISTINCT r, array_to_string(w[s:s + 3], ' ') t FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 2))) s FROM d WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) n FROM sets GROUP BY r),
shared AS (SELECT a.r a, b.r b, count(*) n FROM sets a JOIN sets b ON a.t = b.t AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
reach AS (SELECT r a, r b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n), 0) n_shingles, min(o.doc_id) component_id
FROM d LEFT JOIN sizes USING (r) JOIN reach ON reach.a = d.r JOIN d o ON o.r = reach.b GROUP BY d.r, d.doc_id
"""

OP11 = """
WITH d AS (SELECT page_id, coalesce(html, '') t FROM pages),
top AS (SELECT t, max(page_id) top FROM d GROUP BY t),
signs AS (SELECT page_id, top, strlen(t) n, page_id IS NOT DISTINCT FROM top OR top IS NULL response,
  list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', substr(sha1(t), i, 1)) - 1) x FROM d JOIN top USING (t)),
bits AS (SELECT *, list_transform(range(0, 160), lambda b: (x[b // 4 + 1] >> (3 - b % 4)) & 1) b FROM signs)
SELECT page_id, CAST(n AS BIGINT) payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * b[5 * k + 1] + 8 * b[5 * k + 2] + 4 * b[5 * k + 3] + 2 * b[5 * k + 4] + b[5 * k + 5] AS BIGINT), 1)), '') payload_digest,
  CASE WHEN response THEN 'response' ELSE 'revisit' END record_type, CASE WHEN response THEN NULL ELSE top END refers_to FROM bits
"""

OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') t FROM documents),
first AS (SELECT t, min(doc_id) first FROM d GROUP BY t),
words AS (SELECT doc_id, part, t, coalesce(doc_id > first, false) e, {_WORDS.format(text="t")} w FROM d JOIN first USING (t)),
known AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) good, coalesce(bool_or(toxic = 1), false) toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
fails AS (SELECT part, coalesce(good, false) good, coalesce(toxic, false) toxic, e,
  len(w) < 200 a, 100 * len(list_distinct(w)) < 50 * len(w) b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) c, regexp_matches(t, '[#$%&*|]') d
  FROM words LEFT JOIN known USING (doc_id)),
cells AS (SELECT part, [a, b, c, d, e] f, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) size, count(*) n, count(*) FILTER (good) g, count(*) FILTER (toxic) x FROM fails GROUP BY ALL),
letters AS (SELECT unnest(range(1, 6)) k),
orders AS (SELECT [i.k, j.k, l.k, m.k, o.k] o FROM letters i, letters j, letters l, letters m, letters o WHERE len(list_distinct([i.k, j.k, l.k, m.k, o.k])) = 5),
steps AS (SELECT o, k step, o[k] letter, o[1:k - 1] before FROM orders, letters),
met AS (SELECT part, o, step, size, n, g, x, f[letter] own, len(list_filter(before, lambda y: f[y])) > 0 gone FROM cells, steps)
SELECT part, array_to_string(list_transform(o, lambda y: substr('ABCDE', y, 1)), '') filter_order, CAST(step AS INT) step,
  CAST(coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS BIGINT) kept, CAST(coalesce(sum(n) FILTER (own AND NOT gone), 0) AS BIGINT) removed,
  CAST(coalesce(sum(n) FILTER (own AND gone), 0) AS BIGINT) redundant, CAST(coalesce(sum(n) FILTER (own AND size = 1), 0) AS BIGINT) unique_fails,
  CAST(coalesce(sum(g) FILTER (own AND NOT gone), 0) AS BIGINT) good_lost, CAST(coalesce(sum(x) FILTER (own AND NOT gone), 0) AS BIGINT) toxic_lost,
  CAST(coalesce(sum(n * 120 // greatest(size, 1)) FILTER (own), 0) AS BIGINT) shapley
FROM met GROUP BY part, o, step
"""

ORACLE_SQL = {"op6_recompression": OP6, "op7_suffix_array": OP7, "op8_ngram_join": OP8, "op11_warc": OP11, "op12_filter_audit": OP12}
