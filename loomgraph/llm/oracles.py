"""SQL (DuckDB's) that gives the rows of the corpus queries that SQL can express."""

from __future__ import annotations

import string

_ASCII_LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"

# Sets of five-word shingles, overlap counts of all pairs that share one, and components by reachability.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_ASCII_LOWER}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY 1, 2
"""


def url_trust(rules, damping: float, rounds: int, block_at: float, relative: bool = False) -> str:
    """Rules by CASE, links by regular expressions, and every round of the propagations as a table."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}') THEN '{verdict} {rule}'")
    host = lambda c: f"translate(coalesce(regexp_extract({c}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), {_ASCII_LOWER})"
    href = r"""(?i)<a\s[^>]*?href\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)"""
    out = [
        f"p AS (SELECT page_id, {host('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, html FROM pages)",
        f"j AS (SELECT *, CASE {' '.join(fits)} END AS rule FROM p)",
        f"l AS (SELECT DISTINCT page_id, src, dst FROM (SELECT page_id, host AS src, {host(chr(39) + 'x://' + chr(39) + r''' || regexp_extract(u, '(?s)^[^/]*//(.*)', 1)''')} AS dst FROM (SELECT page_id, host, unnest(regexp_extract_all(coalesce(html, ''), '{href}', 1)) AS u FROM p)) WHERE dst <> '' AND dst <> src)",
        "g AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM l GROUP BY src, dst)",
        "h AS (SELECT host, count(rule) FILTER (WHERE rule LIKE 'allow %') / CAST(count(*) AS DOUBLE) AS good, count(rule) FILTER (WHERE rule LIKE 'block %') / CAST(count(*) AS DOUBLE) AS bad FROM j GROUP BY host UNION ALL SELECT DISTINCT dst, 0.0, 0.0 FROM g WHERE dst NOT IN (SELECT host FROM p))",
    ]
    for name, seed, s, t in (("t", "good", "src", "dst"), ("d", "bad", "dst", "src")):
        out.append(f"{name}w AS (SELECT {s} AS s, {t} AS t, weight / sum(weight) OVER (PARTITION BY {s}) AS w FROM g)")
        out.append(f"{name}0 AS (SELECT host, {seed} AS seed, {1 - damping} * {seed} AS score FROM h)")
        for k in range(1, rounds + 1):
            out.append(f"{name}{k} AS MATERIALIZED (SELECT x.host, seed, {1 - damping} * seed + {damping} * coalesce(got, 0) AS score FROM {name}{k - 1} x LEFT JOIN (SELECT w.t AS host, sum(w.w * y.score) AS got FROM {name}w w JOIN {name}{k - 1} y ON y.host = w.s GROUP BY w.t) z ON z.host = x.host)")
    scale = 1.0 / (1 - damping)
    out.append(f"v AS (SELECT a.host, a.score * {scale} AS trust, b.score * {scale} AS distrust FROM t{rounds} a JOIN d{rounds} b ON a.host = b.host)")
    blocked, more = f"round(distrust, 9) >= {block_at} AND distrust > trust", ""
    if relative:
        out.append("m0 AS (SELECT host, bad AS seed, bad AS met, 0.0 AS got FROM h)")
        for k in range(1, rounds + 1):
            led = f"SELECT x.host, seed, {damping} * coalesce(led, 0) AS got FROM m{k - 1} x LEFT JOIN (SELECT w.s AS host, sum(w.w * y.met) AS led FROM tw w JOIN m{k - 1} y ON y.host = w.t GROUP BY w.s) z ON z.host = x.host"
            out.append(f"m{k} AS MATERIALIZED (SELECT host, seed, seed + (1 - seed) * got AS met, got FROM ({led}))")
        out.append(f"r AS (SELECT v.host, trust, distrust, got AS inherited FROM v JOIN m{rounds} m ON m.host = v.host)")
        blocked, more = f"({blocked}) OR (round(inherited, 9) >= {block_at} AND inherited > trust)", ", round(inherited, 6) AS host_inherited"
    return f"""WITH {', '.join(out)}
SELECT page_id, j.host, path, nullif(split_part(coalesce(rule, ''), ' ', 2), '') AS rule, coalesce(nullif(split_part(coalesce(rule, ''), ' ', 1), ''), CASE WHEN {blocked} THEN 'block' ELSE 'allow' END) AS verdict,
round(trust, 6) AS host_trust, round(distrust, 6) AS host_distrust{more} FROM j JOIN {'r v' if relative else 'v'} ON v.host = j.host"""


#: All anchors with all rows; products of whole numbers are exact in doubles.
HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label, list_dot_product(a.e, r.e)::BIGINT AS score FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
