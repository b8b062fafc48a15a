"""The operators' results in SQL for DuckDB, where SQL can say them.

Token ids, HTML extraction, packing, a fitted machine and 64-bit term hashes are not SQL; tests hold
those queries against brute force, round trips and held-out labels.
"""

from __future__ import annotations

from .warc import ARCHIVE_PAGES, DATE

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED_WORD = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATION = f"""
WITH item AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ITEM_WORD}) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ITEM_WORD}) AS w FROM documents),
placed AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT doc_id, s, n, item_id FROM placed JOIN win USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""

SUBSTRING = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED_WORD}) AS w FROM documents),
win AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM doc WHERE len(w) >= 50)),
rep AS (SELECT doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS m FROM win GROUP BY h) USING (h) WHERE m < doc_id),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM rep, (SELECT unnest(range(50)) AS k)),
word AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM doc)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED_WORD}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * o >= 80 * (s.n + t.n - o)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id FROM reach JOIN documents d ON d.doc_id = a LEFT JOIN size USING (doc_id) GROUP BY doc_id"""

LINES = f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, i, l[i] AS raw, regexp_extract_all(translate(l[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_SPACED_WORD}) AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM split)),
dist AS (SELECT array_to_string(w, ' ') AS k, any_value(w) AS w, any_value(len(w)) AS n, min((doc_id, i)) AS f FROM line WHERE len(w) >= 1 GROUP BY 1),
cut AS (SELECT k, n, f, p, array_to_string(list_concat(w[1:p - 1], w[p + 1:]), ' ') AS v FROM (SELECT k, w, n, f, unnest(range(1, n + 1)) AS p FROM dist WHERE n >= 8)),
sub AS (SELECT p, v, min(f) AS e FROM cut GROUP BY ALL),
near AS (SELECT k FROM cut JOIN sub USING (p, v) WHERE e < f UNION SELECT cut.k FROM cut JOIN dist ON dist.k = cut.v AND dist.n = cut.n - 1 WHERE dist.n >= 8 AND dist.f < cut.f
  UNION SELECT dist.k FROM cut JOIN dist ON dist.k = cut.v AND dist.n = cut.n - 1 WHERE dist.n >= 8 AND cut.f < dist.f),
marked AS (SELECT doc_id, i, raw, coalesce(f < (doc_id, i), false) OR near.k IS NOT NULL AS gone FROM line LEFT JOIN dist ON len(line.w) >= 1 AND dist.k = array_to_string(line.w, ' ') LEFT JOIN near ON near.k = dist.k),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '') AS t FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(t) END AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)"""

FIXITY = f"""
WITH page AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
rec AS (SELECT page_id, url, html, page_id // {ARCHIVE_PAGES} AS archive, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
  || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10)
  || html || chr(13) || chr(10) || chr(13) || chr(10) AS r FROM page),
placed AS (SELECT archive, page_id, html, strlen(r) AS length, CAST(sum(strlen(r)) OVER (PARTITION BY archive ORDER BY page_id) - strlen(r) AS BIGINT) AS "offset" FROM rec)
SELECT archive, "offset", length, page_id, CASE WHEN page_id % 211 = 7 THEN 'missing' ELSE 'changed' END AS kind FROM placed WHERE page_id % 211 = 7 OR (page_id % 97 = 13 AND html <> '')"""

PHRASES = f"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
word AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM piece),
gram AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM word, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)),
total AS (SELECT lang, count(*) AS n FROM gram WHERE k = 1 GROUP BY lang),
freq AS (SELECT lang, k, g, string_split(g, ' ') AS w, count(*) AS f FROM gram GROUP BY lang, k, g HAVING count(*) >= 30),
cand AS (SELECT * FROM freq WHERE k > 1),
inside AS (SELECT lang, g, max(f) AS longer FROM (SELECT lang, f, array_to_string(w[i:i + s - 1], ' ') AS g FROM (SELECT lang, w, k, f, s, unnest(range(1, k - s + 2)) AS i FROM cand, (SELECT unnest(range(2, 4)) AS s) WHERE s < k)) GROUP BY lang, g),
cut AS (SELECT lang, g, w, f AS a, k, unnest(range(1, k)) AS c FROM cand LEFT JOIN inside USING (lang, g) WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * f::HUGEINT),
scored AS (SELECT cut.lang, cut.g, a, c, x.f AS l, y.f AS r, 2000000::HUGEINT * a // (x.f + y.f) AS score FROM cut
  JOIN freq x ON x.lang = cut.lang AND x.g = array_to_string(cut.w[1:c], ' ') JOIN freq y ON y.lang = cut.lang AND y.g = array_to_string(cut.w[c + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score::BIGINT AS score FROM best JOIN total USING (lang) QUALIFY rank <= 2000"""

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

SEARCH = f"""
WITH term AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({_LOWER}, {_TERM}) AS w FROM documents),
size AS (SELECT d, doc_id, len(w) AS n FROM term WHERE len(w) > 0),
stat AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM size),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, {_TERM})) AS t FROM benchmark),
post AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM term) SEMI JOIN item USING (t) GROUP BY d, t),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, stat GROUP BY t, nn),
gain AS (SELECT d, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))) AS g FROM post JOIN wt USING (t) JOIN size USING (d), stat),
score AS (SELECT item_id, d, doc_id, CAST(sum(g) AS BIGINT) AS score FROM item JOIN gain USING (t) GROUP BY item_id, d, doc_id HAVING sum(g) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM score QUALIFY rank <= 50"""

ORACLES = {
    "op2_decontamination": DECONTAMINATION,
    "op5_substring_dedup": SUBSTRING,
    "op6_warc_fixity": FIXITY,
    "op8_ngram_jaccard_join": JACCARD,
    "op9_line_dedup": LINES,
    "op11_phrase_mining": PHRASES,
    "op13_ranked_search": SEARCH,
}
