"""SQL for DuckDB with the rows of the queries that SQL can express, over whole tables and whole texts.

The SQL states what a result is, without the operators' methods: all windows of all texts (op1, op8), all pairs that share a
shingle (op6), all words (op4) and all matches (op9). Nearest neighbours (op2) are found by brute force; the operator is
approximate by method, so a rare difference is possible there. Sharding depends on a hash that DuckDB lacks; the fitted
models and the tokenizer are beyond SQL.
"""

from __future__ import annotations

import re
import string

from tessera.llm import licenses, secrets

LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
ALNUM = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"


def suffixes(least: int = 400, words: int = 50) -> str:
    return f"""
WITH t AS (SELECT doc_id, {SPACED} AS w FROM documents),
tw AS (SELECT doc_id, unnest(range(1, len(w) - {words - 2})) AS i, w FROM t WHERE len(w) >= {words}),
th AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {words - 1}], ' ')) AS h FROM tw),
t2 AS (SELECT h FROM th GROUP BY h HAVING count(*) > 1),
gap AS (SELECT doc_id, least({words}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {words})) AS n FROM th SEMI JOIN t2 USING (h)),
pass AS (SELECT doc_id, sum(n) AS n FROM gap GROUP BY doc_id),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(1, n - {least - 2})) AS i, b FROM d WHERE n >= {least}),
h AS (SELECT doc_id, i, md5(b[i : i + {least - 1}]) AS h FROM w),
twice AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {least}, true) AS fresh FROM h SEMI JOIN twice USING (h)),
run AS (SELECT doc_id, i, sum(fresh::int) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
span AS (SELECT doc_id, min(i) AS a, max(i) + {least} AS z FROM run GROUP BY doc_id, k),
cut AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS lo, a - 1 AS hi, z - a AS gone FROM span
  UNION ALL SELECT d.doc_id, coalesce(max(z), 1), any_value(n), NULL FROM d LEFT JOIN span ON d.doc_id = span.doc_id GROUP BY d.doc_id),
kept AS (SELECT c.doc_id, any_value(n) AS n, sum(gone) AS gone, count(gone) AS spans, string_agg(CASE WHEN hi >= lo THEN hex(b[lo : hi]) ELSE '' END, '' ORDER BY lo, hi) AS hex
  FROM cut c JOIN d ON c.doc_id = d.doc_id GROUP BY c.doc_id)
SELECT doc_id, kept.n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(hex)) AS kept_sha256, coalesce(pass.n, 0)::BIGINT AS n_passage_words
FROM kept LEFT JOIN pass USING (doc_id)"""


def neighbours(k: int = 20, every: int = 20) -> str:
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_reduce(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM v q JOIN v ON q.vec_id % {every} = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {k}"""


def license_scan() -> str:
    labels, step = [], max(len(text.split()) for text, _ in licenses.NOTICES)
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        here = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts, 1))
        labels.append(f"SELECT doc_id, '{label}' AS label, i, NULL::DOUBLE AS share FROM places WHERE {here}")
    for text, label in licenses.NOTICES:
        members = sorted(set(text.split()))
        least = licenses.need(len(members), licenses.NOTICE_SHARE)
        shared = f"len(list_intersect(w, [{', '.join(repr(m) for m in members)}]))"
        labels.append(f"SELECT doc_id, '{label}' AS label, NULL AS i, {shared} / {len(members)}.0::DOUBLE AS share FROM block WHERE {shared} >= {least}")
    union = "\n  UNION ALL ".join(labels)
    return f"""
WITH d AS (SELECT doc_id, {ALNUM} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
block AS (SELECT doc_id, w[j + 1 : j + {2 * step}] AS w FROM (SELECT doc_id, w, unnest(range(0, len(w), {step})) AS j FROM d)),
f AS ({union}),
g AS (SELECT doc_id, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (i IS NOT NULL) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, CASE WHEN count(i) > 0 THEN 1.0::DOUBLE ELSE max(share) END AS score FROM f GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


def jaccard(n: int = 3, percent: int = 90) -> str:
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {SPACED} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct([{joined} for i in range(1, len(w) - {n - 2})])) END AS s FROM d),
node AS (SELECT min(doc_id) AS a, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
x AS MATERIALIZED (SELECT a, n, unnest(s) AS h FROM node),
link AS MATERIALIZED (SELECT x.a AS a, y.a AS b FROM x JOIN x y ON x.h = y.h AND x.a < y.a AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
  GROUP BY x.a, y.a, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE least(node.a, coalesce(low.b, node.a)) END AS component_id
FROM s LEFT JOIN node ON s.s = node.s LEFT JOIN low ON low.a = node.a"""


def decontamination(length: int = 10) -> str:
    return rf"""
WITH item AS (SELECT item_id, {ALNUM} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS t
  FROM (SELECT item_id, w, least(len(w), {length}) AS size, unnest(range(1, greatest(len(w) - {length}, 0) + 2)) AS i FROM item WHERE len(w) > 0)),
d AS (SELECT doc_id, {ALNUM} AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hit AS MATERIALIZED (SELECT p.doc_id, p.i, win.size, win.item_id FROM (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS t
  FROM pos JOIN (SELECT DISTINCT size FROM win) sizes ON i + size - 1 <= len(w)) p JOIN win ON p.size = win.size AND p.t = win.t),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""


def _either_case(pattern: str) -> str:
    """The pattern with each letter outside of classes and escapes as a class of its two ASCII cases."""
    return re.sub(r"\[[^]]*]|\\x..|([a-z])", lambda m: f"[{m[1]}{m[1].upper()}]" if m[1] else m[0], pattern)


def secret_scan() -> str:
    """Matches are put between two private-use characters; offsets follow from the lengths of the parts."""
    rules = {kind: (pattern.pattern, 1) for kind, (_, pattern) in secrets._MORE.items()}
    rules |= {"assign": (_either_case(secrets._ASSIGN.pattern), 12), "access": (secrets._ACCESS.pattern, 18), "hex": (secrets._HEX.pattern, 16)}
    found = []
    for order, kind in enumerate(secrets.KINDS):
        pattern, least = rules[kind]
        measured = "length(regexp_extract(m, '[A-Za-z0-9+/_.=-]+$'))" if kind == "assign" else "length(m)"
        quoted = pattern.replace("'", "''")
        found.append(
            f"""SELECT doc_id, {order} AS o, '{kind}' AS kind, sum(length(m) + length(gap)) OVER (PARTITION BY doc_id ORDER BY k) - length(m) - length(gap) + lead AS a, length(m) AS size, {measured} >= {least} AS on
  FROM (SELECT doc_id, lead, k, split_part(part, chr(57345), 1) AS m, split_part(part, chr(57345), 2) AS gap
    FROM (SELECT doc_id, length(parts[1]) AS lead, unnest(range(2, len(parts) + 1)) AS k, unnest(parts[2:]) AS part
      FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '{quoted}', chr(57344) || '\\0' || chr(57345), 'g'), chr(57344)) AS parts FROM documents)))"""
        )
    union = "\n  UNION ALL ".join(found)
    counts = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in secrets.BASE)
    sums = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)
    return f"""
WITH f AS ({union}),
g AS (SELECT doc_id, {sums}, string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, o) AS spans,
  string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, o) FILTER (o < {len(secrets.BASE)}) AS base FROM f WHERE "on" GROUP BY doc_id)
SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_array_dedup": suffixes(), "op2_nearest_neighbours": neighbours(), "op4_license_scans": license_scan(), "op6_ngram_jaccard_join": jaccard(),
        "op8_decontamination": decontamination(), "op9_secret_scans": secret_scan(),
    }
