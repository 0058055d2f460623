"""DuckDB SQL that must give the rows of the queries; operators that SQL can't express are tested by brute force instead."""

SQL: dict[str, str] = {}

_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format(t="coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


# The SQL's own tables: phrases, and the sentences of the licenses.
_LICENSES = """phrases(label, p) AS (VALUES ('mit', ['under','the','mit','license']), ('apache-2', ['apache','license','version','2']), ('cc-by-nc', ['cc','by','nc'])),
sentences(label, s) AS (VALUES
  ('mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction'),
  ('apache-2', 'licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at'),
  ('bsd', 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met'),
  ('isc', 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies'),
  ('gpl', 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation'),
  ('gpl-3', 'this work is licensed under the gnu general public license version 3'),
  ('lgpl', 'this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation'),
  ('mpl-2', 'this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at'),
  ('cc-by', 'this work is licensed under a creative commons attribution 4 0 international license'),
  ('cc-by-sa', 'this work is licensed under a creative commons attribution sharealike 4 0 international license'),
  ('cc-by-nc', 'this work is licensed under a creative commons attribution noncommercial 4 0 international license'),
  ('unlicense', 'this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software'))"""

SQL["op2_licenses"] = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), {_LICENSES},
hits AS (SELECT r, label, i FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w), phrases WHERE w[i] = p[1] AND w[i:i + len(p) - 1] = p),
base AS (SELECT r, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY r),
plain AS (SELECT label, len(string_split(s, ' ')) AS n, list_distinct(string_split(s, ' ')) AS t FROM sentences),
rivals AS (SELECT a.label, b.label AS rival, b.n, b.t, list_filter(a.t, lambda x: NOT list_contains(b.t, x)) AS apart FROM plain a JOIN plain b ON a.label <> b.label AND len(list_intersect(a.t, b.t)) >= 0.8 * least(len(a.t), len(b.t)) - 1e-9),
templates AS (SELECT plain.label, plain.t, greatest(plain.n, coalesce(max(rivals.n), 0)) AS size, coalesce(list_distinct(flatten(list(rivals.apart) FILTER (rival IS NOT NULL))), []) AS telling FROM plain LEFT JOIN rivals USING (label) GROUP BY plain.label, plain.t, plain.n),
near AS (SELECT r, w, label, t, telling, greatest(size // 2, 1) AS step, size FROM w, templates WHERE len(list_intersect(w, t)) >= 0.8 * len(t) - 1e-9),
blocks AS (SELECT r, label, t, telling, k, w[k * step + 1:k * step + 2 * size + step] AS b FROM (SELECT *, unnest(range(0, (len(w) - 1) // step + 1)) AS k FROM near)),
held AS (SELECT r, label, k, b, len(list_intersect(b, t)) AS n, len(t) AS whole FROM blocks WHERE len(list_intersect(b, t)) >= 0.8 * len(t) - 1e-9 AND len(list_intersect(b, telling)) = len(telling)),
beaten AS (SELECT DISTINCT held.r, held.label, held.k FROM held JOIN rivals USING (label) JOIN templates u ON u.label = rival
  WHERE len(list_intersect(b, u.t)) > held.n AND len(list_intersect(b, u.t)) >= 0.8 * len(u.t) - 1e-9 AND len(list_intersect(b, u.telling)) = len(u.telling)),
reached AS (SELECT r, label, max(n / whole) AS share FROM held ANTI JOIN beaten USING (r, label, k) GROUP BY r, label),
labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM hits UNION ALL SELECT r, label FROM reached) GROUP BY r),
best AS (SELECT r, max(share) AS share FROM reached GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN labels USING (r) LEFT JOIN best USING (r)"""

SQL["op7_line_dedup"] = r"""
WITH lines AS (SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[ 	-
]+', ''), '[ 	-
]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
frequent AS (SELECT k, max(doc_id) AS owner FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT lines.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM lines LEFT JOIN frequent USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""

SQL["op3_decontamination"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, x, len(x) AS n FROM (SELECT item_id, w[i:i + least(10, len(w)) - 1] AS x FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT doc_id, n, i, w[i:i + n - 1] AS x FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT doc_id, item_id, i, spots.n FROM spots JOIN windows USING (x)),
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits),
n_hit AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY doc_id),
report AS (SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id))
SELECT * FROM report"""

SQL["op10_exact_dedup"] = r"""
WITH plain AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
best AS (SELECT t, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM plain GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM plain JOIN best USING (t)"""

_RULES = "(VALUES ('allow','org','/'),('block','example.org','/es/'),('block','example.org','/en/1'),('allow','com','/fr/'),('block','com','/de/')) r(v, h, p)"
_HOST = r"translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract({u}, '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"

SQL["op9_url_filter"] = rf"""
WITH RECURSIVE parsed AS (SELECT page_id, {_HOST.format(u="coalesce(url, '')")} AS host, {_PATH.format(u="coalesce(url, '')")} AS path, url, html FROM pages),
tags AS (SELECT host, path, url, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\b[^>]*>')) AS t FROM parsed WHERE host <> ''),
raw AS (SELECT host, path, url, regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS x FROM tags WHERE regexp_matches(t, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b')
  UNION ALL SELECT host, path, url, regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM tags WHERE regexp_matches(t, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b')),
whole AS (SELECT host, path, CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN x WHEN x LIKE '//%' THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || x
  WHEN x LIKE '/%' THEN regexp_extract(url, '(?s)^(.*?)://', 1) || '://' || host || x END AS x FROM raw),
edges AS (SELECT DISTINCT host || path AS a, {_HOST.format(u="x")} || {_PATH.format(u="x")} AS b, {_HOST.format(u="x")} AS bh, {_PATH.format(u="x")} AS bp FROM whole WHERE x IS NOT NULL AND {_HOST.format(u="x")} <> ''),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
places AS (SELECT host || path AS k, host, path FROM parsed WHERE host <> '' UNION SELECT b, bh, bp FROM edges),
ruled AS (SELECT k, first(h || p ORDER BY length(h || p) DESC, v) AS rule, first(v ORDER BY length(h || p) DESC, v) AS v
  FROM places, {_RULES} WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY k),
reach AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT x, b FROM reach JOIN both_ways ON y = a),
tied AS (SELECT x, bool_or(v = 'block') AND NOT bool_or(v = 'allow') AS blocked FROM reach JOIN ruled ON y = k GROUP BY x)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed LEFT JOIN ruled ON host || path = k LEFT JOIN tied ON host || path = x"""

SQL["op13_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 5"""
