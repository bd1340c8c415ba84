"""DuckDB SQL of the queries that SQL expresses at the size of the correctness run."""

from __future__ import annotations

from . import license_scan

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')"

DECONTAMINATE = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
 bi AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
 win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bi),
 di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
 hit AS (SELECT doc_id, i, di.n, item_id FROM di JOIN win ON di.n = win.n AND win.s = array_to_string(w[i:i + di.n - 1], ' ')),
 places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
 own AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN own USING (doc_id)"""

SIMILAR = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
 di AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0),
 s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 2], ' ')) AS h FROM di),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 90 * (p.n + q.n - o)),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
 c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id"""

_SEPARATED = "string_split_regex({0}, '[.,;:!?\\x0A-\\x0D]')".format(_FOLD)
COLLOCATIONS = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest({_SEPARATED}) AS p FROM documents),
 s AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
 n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM s GROUP BY lang),
 g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM s, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
 f AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
 c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
 inner_sizes AS (SELECT lang, w, k, a, unnest(range(2, k)) AS m FROM c),
 inner_phrases AS (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM inner_sizes),
 covered AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL),
 kept AS (SELECT c.* FROM c LEFT JOIN covered USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
 places AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS j FROM kept),
 cuts AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM places),
 scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, fl.a AS l, fr.a AS r, n, CAST(1000 * CAST(cuts.a AS HUGEINT) * n // (CAST(fl.a AS HUGEINT) * fr.a) AS BIGINT) AS score
  FROM cuts JOIN f fl ON fl.lang = cuts.lang AND fl.phrase = x JOIN f fr ON fr.lang = cuts.lang AND fr.phrase = y JOIN n ON n.lang = cuts.lang),
 best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best QUALIFY rank <= 2000"""


_LOWER_T = f"translate(t, '{_UP}', '{_LOW}')"
_QUOTED = [(i, int(i < len(license_scan.TEMPLATES)), name, text.replace("'", "''")) for i, (name, text) in enumerate(license_scan.TEMPLATES + license_scan.TEXTS)]
_TEMPLATES = ", ".join(f"({i}, {part}, '{name}', '{text}')" for i, part, name, text in _QUOTED)
_STOPPED = "string_split(regexp_replace({0}, '" + license_scan.STOP + "', '\\1' || chr(10), 'g'), chr(10))"
_COMMENT = license_scan.COMMENT.replace("'", "''")

LICENCES = rf"""WITH files AS (SELECT doc_id, text, coalesce(source, 'none') || '/' || coalesce(CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR), 'none') || '/' || coalesce(CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR), 'none') || '/' || CASE WHEN doc_id % 100 = 0 THEN 'LICENSE.' || CAST(doc_id AS VARCHAR) ELSE coalesce(CAST(doc_id AS VARCHAR), 'none') || '.txt' END AS path FROM documents),
 folded AS (SELECT row_number() OVER () AS f, path, regexp_replace(translate(text, '{_UP}', '{_LOW}'), '\r\n?', chr(10), 'g') || chr(10) AS t FROM files WHERE text IS NOT NULL),
 bare AS (SELECT f, t, regexp_replace(t, '{_COMMENT}', '', 'g') AS s FROM folded),
 para AS (SELECT f, unnest(string_split_regex(s, '{license_scan.GAP}')) AS p FROM bare),
 unit AS (SELECT f, regexp_extract(t, '{license_scan.HEADER}') AS u FROM bare UNION ALL SELECT f, s FROM bare UNION ALL SELECT f, p FROM para UNION ALL SELECT f, unnest({_STOPPED.format("p")}) FROM para UNION ALL SELECT f, unnest({_STOPPED.format("replace(p, chr(10), ' ')")}) FROM para),
 tk AS (SELECT row_number() OVER () AS k, f, w FROM (SELECT f, regexp_extract_all(u, '{license_scan.TERM}') AS w FROM unit) WHERE len(w) > 0),
 tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM tk) GROUP BY ALL),
 tpl AS (SELECT * FROM (VALUES {_TEMPLATES}) v(i, part, name, t)),
 ttf AS (SELECT i, term, count(*) AS tf FROM (SELECT i, unnest(regexp_extract_all({_LOWER_T}, '{license_scan.TERM}')) AS term FROM tpl) GROUP BY ALL),
 n AS (SELECT (SELECT count(*) FROM tk) + (SELECT count(*) FROM tpl) AS n),
 df AS (SELECT term, sum(c) AS df FROM (SELECT term, count(*) AS c FROM tf WHERE term IN (SELECT term FROM ttf) GROUP BY term UNION ALL SELECT term, count(*) FROM ttf GROUP BY term) GROUP BY term),
 idf AS (SELECT term, ln((n + 1) / (df + 1)) + 1 AS idf FROM df, n),
 a AS (SELECT k, sqrt(sum((tf * coalesce(idf, ln((n + 1) / 2) + 1)) ** 2)) AS a FROM tf LEFT JOIN idf USING (term), n GROUP BY k),
 b AS (SELECT i, sqrt(sum((tf * idf) ** 2)) AS b FROM ttf JOIN idf USING (term) GROUP BY i),
 dots AS (SELECT k, i, sum(x.tf * idf * y.tf * idf) AS dot FROM tf x JOIN ttf y ON x.term = y.term JOIN idf ON idf.term = x.term GROUP BY k, i),
 scored AS (SELECT path, part, name, least(1.0, round(dot / (a * b), 9)) AS score FROM dots JOIN a USING (k) JOIN b USING (i) JOIN tpl USING (i) JOIN tk USING (k) JOIN folded USING (f)),
 own AS (SELECT path, name AS licence, score FROM scored WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY path ORDER BY part, score DESC, name) = 1),
 holders AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, licence, score, path AS licence_from FROM own WHERE regexp_matches(path, '{license_scan.LICENCE_FILES}') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence, licence_from) = 1),
 bare_paths AS (SELECT DISTINCT path, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS parts FROM files WHERE path NOT IN (SELECT path FROM own)),
 up AS (SELECT path, depth, array_to_string(parts[1:depth], '/') AS dir FROM (SELECT path, parts, unnest(range(0, len(parts) + 1)) AS depth FROM bare_paths)),
 below AS (SELECT path, licence, score, licence_from FROM up JOIN holders USING (dir) QUALIFY row_number() OVER (PARTITION BY path ORDER BY depth DESC) = 1),
 every AS (SELECT path, licence, score, path AS licence_from FROM own UNION ALL SELECT path, licence, score, licence_from FROM below)
SELECT doc_id, path, licence, score, licence_from FROM files LEFT JOIN every USING (path)"""


def oracle_sql() -> dict[str, str]:
    return {"op6_ngram_join": SIMILAR, "op7_decontaminate": DECONTAMINATE, "op9_license_scan": LICENCES, "op12_collocations": COLLOCATIONS}
