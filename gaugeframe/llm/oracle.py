"""DuckDB SQL for the operators that SQL can express on whole tables."""

from . import license

W = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t, text AS raw FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{W}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{W}')) AS l FROM d),
tri AS (SELECT r, i, hash(w[i], w[i + 1], w[i + 2]) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, h) > 1),
n_rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY r),
line AS (SELECT r, host, raw, lower(array_to_string(regexp_extract_all(x, '{W}'), ' ')) AS h, len(regexp_extract_all(x, '{W}')) AS n FROM (SELECT r, host, raw, unnest(l) AS x FROM w)),
bad AS (SELECT host, h, count(DISTINCT coalesce(raw, '')) AS n FROM line GROUP BY ALL HAVING count(DISTINCT coalesce(raw, '')) >= 20),
gone AS (SELECT r, sum(line.n) AS n FROM line JOIN bad ON line.host IS NOT DISTINCT FROM bad.host AND line.h = bad.h GROUP BY r),
x AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_rep.n, 0) AS n_repeat_words, len(w) - coalesce(gone.n, 0) AS n_left
  FROM w LEFT JOIN n_rep USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_left >= 0.3 * n_words AS kept FROM x
"""

NEAR = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{W}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : least(i + 4, len(w))], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS x FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT i, j FROM p JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * x >= 75 * (a.n + b.n - x)),
c(doc_id, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT c.doc_id, e.j FROM c JOIN e ON c.seen = e.i),
m AS (SELECT doc_id, min(seen) AS component_id FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.doc_id = d.doc_id
"""

_list = lambda xs: "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in xs) + "]"
_templates = ", ".join(f"({n}, '{label}', {_list(words)}::VARCHAR[], {_list(musts)}::INT[])" for n, label, words, musts in license.template_rows(license.TEMPLATES, 4))
_places = lambda p: "list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"coalesce(w[i + {j}] = '{x}', false)" for j, x in enumerate(p.split())) + ")"
_phrases = {f"p{i}": (label, _places(p)) for i, (label, p) in enumerate(license.PHRASES.items())}

LICENSE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(translate(coalesce(text, ''), '{license.UPPER}', '{license.UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(template, label, words, musts) AS (VALUES {_templates}),
g AS (SELECT template, label, len(words) AS t_words, musts, unnest(range(0, len(words) - 3)) AS t_pos, words FROM t),
tg AS (SELECT * EXCLUDE words, array_to_string(words[t_pos + 1 : t_pos + 4], ' ') AS h FROM g),
dg AS (SELECT r, i - 1 AS pos, array_to_string(w[i : i + 3], ' ') AS h FROM (SELECT r, w, unnest(range(1, len(w) - 2)) AS i FROM d)),
line AS (SELECT r, template, label, t_words, musts, pos - t_pos AS diagonal, list(t_pos) AS places, min(pos) AS a, max(pos) AS z FROM dg JOIN tg USING (h) GROUP BY ALL),
apart AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > 3 THEN 1 ELSE 0 END AS apart FROM line),
numbered AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM apart),
merged AS (SELECT r, template, label, t_words, musts, span, list_distinct(flatten(list_transform(flatten(list(places)), lambda p: range(p, p + 4)))) AS covered, min(a) AS a, max(z) + 3 AS z FROM numbered GROUP BY ALL),
good AS (SELECT r, label, len(covered) / t_words AS cover FROM merged WHERE len(covered) / t_words >= 0.75 AND len(list_filter(musts, lambda m: NOT list_contains(covered, m))) = 0 AND z - a + 1 <= 2 * t_words),
found AS (SELECT r, list(DISTINCT label) AS more, max(cover) AS cover FROM good GROUP BY r),
b AS (SELECT *, {', '.join(f'{q} AS {k}' for k, (_, q) in _phrases.items())} FROM d),
c AS (SELECT r, doc_id, len(w) AS n_words, list_concat(list_concat(p0, p1), p2) AS every, list_filter([{', '.join(f"CASE WHEN len({k}) > 0 THEN '{label}' END" for k, (label, _) in _phrases.items())}], lambda x: x IS NOT NULL) AS base FROM b)
SELECT doc_id, n_words, len(every) AS n_base, list_min(every) - 1 AS first_word, list_max(every) - 1 AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels, coalesce(cover, 0.0) AS score FROM c LEFT JOIN found USING (r)
"""

ORACLES: dict[str, str] = {"op5_line_quality": QUALITY, "op6_near_duplicates": NEAR, "op8_license_scan": LICENSE}
