"""SQL that gives the rows of those queries which SQL can express, by brute force."""

from __future__ import annotations

from parlance.llm import licenses, secrets


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
 r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, n.n"""


def _secrets() -> str:
    parts = []
    for i, (kind, (pattern, group, least)) in enumerate((secrets.BASE | secrets.MORE).items()):
        if group == 0 and least:
            fixed = pattern[: pattern.rindex("[")]
            pattern, least = f"{pattern[:-1]}{{{least - len(fixed)},}}", 0
        p = _quoted(pattern)
        parts.append(
            f"SELECT doc_id, {i} AS nth, '{kind}' AS kind, place + length(hit) AS stop, place, part FROM (SELECT doc_id, hits[i] AS hit, parts[i] AS part, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) AS BIGINT) AS place"
            f" FROM (SELECT doc_id, regexp_split_to_array(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits, regexp_extract_all(text, {p}, {group}) AS parts, unnest(range(1, len(regexp_extract_all(text, {p})) + 1)) AS i FROM d)) WHERE length(part) >= {least}"
        )
    n = len(secrets.BASE)
    counts = ", ".join(f"count(*) FILTER (nth = {i}) AS n_{k}" for i, k in enumerate(secrets.BASE))
    span = "kind || ':' || place || ':' || stop"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), h AS ({' UNION ALL '.join(parts)}),
 g AS (SELECT doc_id, {counts}, coalesce(string_agg({span}, ',' ORDER BY place, nth) FILTER (nth < {n}), '') AS base, string_agg({span}, ',' ORDER BY place, nth) AS spans FROM h GROUP BY doc_id)
 SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


def _licenses() -> str:
    t = licenses.THRESHOLD
    values = ", ".join(f"({i}, {_quoted(k)}, {_quoted(v)})" for i, (k, v) in enumerate(licenses.TEMPLATES.items()))
    norm = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    words = r"list_filter(regexp_split_to_array({}, '[ \n]+'), lambda x: x <> '')"
    return f"""WITH t AS (SELECT nth, license, {grams} AS b FROM (SELECT nth, license, {words.format(norm.format('text'))} AS w FROM (VALUES {values}) v(nth, license, text))),
 l AS (SELECT doc_id, string_split({norm.format('text')}, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
 u AS (SELECT doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS line, unnest(l) AS unit FROM l UNION ALL SELECT doc_id, -1, array_to_string(l, ' ') FROM l WHERE len(l) > 1),
 g AS (SELECT doc_id, line, {grams} AS a FROM (SELECT doc_id, line, {words.format('unit')} AS w FROM u)),
 m AS (SELECT doc_id, line, license, nth, CAST(len(list_intersect(a, b)) AS BIGINT) AS shared, CAST(len(a) AS BIGINT) AS unit_bigrams, CAST(len(b) AS BIGINT) AS template_bigrams FROM g JOIN t ON len(a) BETWEEN {t / (2 - t)} * len(b) - 1e-9 AND {(2 - t) / t} * len(b) + 1e-9)
 SELECT doc_id, line, license, shared, unit_bigrams, template_bigrams, round(2.0 * shared / (unit_bigrams + template_bigrams), 6) AS dice FROM m WHERE 2.0 * shared / (unit_bigrams + template_bigrams) >= {t}
 QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY 2.0 * shared / (unit_bigrams + template_bigrams) DESC, nth) = 1"""


INFILL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]', 0, 's') AS u, sha256('1:' || doc_id) AS x FROM documents),
 h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
 c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR doc_id IS NULL OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
 p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

#: Runs by all pairs of places that hold the same six words: in any run of 12 words such places lie a period apart.
PERIODIC = r"""WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i)),
 t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(tab[1 + (xor(c, x) & 255)], c >> 8))) AS h FROM documents, tab),
 a AS (SELECT *, len(t) AS n, CASE WHEN h % 10 = 0 AND len(t) > 0 THEN (h // 10) % len(t) END AS a FROM t),
 w AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN t ELSE list_transform(range(0, n), lambda i: CASE WHEN i >= a THEN t[1 + a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8))] ELSE t[1 + i] END) END AS w FROM a),
 g AS (SELECT doc_id, unnest(range(0, n - 5)) AS i, unnest(list_transform(range(1, n - 4), lambda i: array_to_string(w[i:i + 5], ' '))) AS g FROM w WHERE n >= 12),
 e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
 s AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e) GROUP BY doc_id, q, k HAVING count(*) + 5 + q >= greatest(12, 2 * q)),
 r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.q < s.q AND o.start <= s.start AND o.start + o.length >= s.start + s.length)),
 k AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
 c AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text FROM (SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS word FROM w) w ANTI JOIN k ON k.doc_id = w.doc_id AND k.i = w.i GROUP BY w.doc_id),
 b AS (SELECT doc_id, count(*) AS n_runs, arg_min({'start': start, 'length': length, 'period': q}, {'l': -length, 's': start, 'q': q}) AS m, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS l FROM r GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, m.start AS start, m.length AS length, m.period AS period, 1000 * m.length // m.period AS exponent_milli,
  sha256(coalesce(l, '')) AS runs_sha256, sha256(coalesce(c.text, '')) AS collapsed_sha256 FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)"""

ORACLES = {"op1_licenses": _licenses(), "op3_topk": TOPK, "op9_secrets": _secrets(), "op10_jaccard": JACCARD, "op12_infill": INFILL, "op13_periodic": PERIODIC}
