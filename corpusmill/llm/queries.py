"""The queries of the training-data operators and the SQL that their results are held against."""

from __future__ import annotations

import corpus_pipeline

from .decontaminate import op3_decontaminate
from .html_text import op9_html_text
from .line_dedup import op8_line_dedup
from .mixing import op2_mix_sources
from .ngram_join import op10_ngram_jaccard_join
from .secret_scan import op4_secret_scan
from .substrings import op7_substring_dedup
from .toxicity import op6_toxicity
from .url_filter import op1_url_filter
from .vector_search import op5_nearest

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_mix_sources": op2_mix_sources,
    "op3_decontaminate": op3_decontaminate,
    "op4_secret_scan": op4_secret_scan,
    "op5_nearest": op5_nearest,
    "op6_toxicity": op6_toxicity,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_html_text": op9_html_text,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "pipeline": corpus_pipeline.run,
}

WORD = r"'[^\x20\x09-\x0D]+'"



def _secrets() -> str:
    from .secret_scan import KINDS

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    kinds = " UNION ALL ".join(
        f"SELECT row, '{kind}' AS kind, {i} AS rank, string_split_regex(t, {quoted(p)}) AS gaps, regexp_extract_all(t, {quoted(p)}) AS hits, regexp_extract_all(t, {quoted(p)}, {group}) AS vals, {least} AS least FROM d"
        for i, (kind, p, group, least) in enumerate(KINDS)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source AS repo, lang AS owner, coalesce(text, '') AS t FROM documents),
k AS ({kinds}),
h AS (SELECT *, unnest(vals) AS v, generate_subscripts(vals, 1) AS i FROM k WHERE len(hits) > 0),
p AS (
  SELECT row, kind, rank, v, length(hits[i]) AS n,
    (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM h WHERE length(v) >= least),
base AS (SELECT * FROM p WHERE rank < 3),
opaque AS (
  SELECT * FROM p WHERE rank = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, '[a-z]{{6}}')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = p.row AND b.s < p.s + p.n AND b.s + b.n > p.s)),
each AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
spread AS (SELECT v, count(DISTINCT coalesce(repo, '')) <= 2 AND count(DISTINCT coalesce(owner, '')) <= 2 AS live FROM each JOIN d USING (row) GROUP BY v),
out AS (
  SELECT row, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base,
    string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER (WHERE rank < 3 OR live) AS spans,
    count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example
  FROM each JOIN spread USING (v) GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN out ON d.row = out.row"""


def _urls() -> str:
    from .url_filter import FOLD_FROM, FOLD_REST, FOLD_TO, LOWER, ORDER, PARTS, RULES, SYMBOLS, UPPER

    def fits(host: str, path: str) -> str:
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"

    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in longest)
    label = " ".join(f"WHEN {fits(h, p)} THEN '{a}'" for a, h, p in longest)
    state = " + ".join(f"(ascii(substr(w, {k + 1}, 1)) - 64) * {SYMBOLS ** (ORDER - k)}" for k in range(ORDER + 1))
    levels = []
    for k in range(ORDER + 1):
        own = f"(g % {SYMBOLS**k})"
        every = f"SELECT x AS g, x // {SYMBOLS} AS c FROM generate_series(0, {SYMBOLS ** (k + 1) - 1}) t(x)" if k < ORDER else f"SELECT c * {SYMBOLS} + x AS g, c FROM x{k}, generate_series(0, {SYMBOLS - 1}) t(x)"
        lower = f"JOIN p{k - 1} q ON q.g = e.g % {SYMBOLS**k}" if k else f"CROSS JOIN (SELECT 1.0::DOUBLE / {SYMBOLS} AS pa, 1.0::DOUBLE / {SYMBOLS} AS pr) q"
        ps = ", ".join(
            f"CASE WHEN coalesce(n{x}, 0) + coalesce(t{x}, 0) > 0 THEN (coalesce(n.{x}, 0)::DOUBLE + coalesce(t{x}, 0)::DOUBLE * q.p{x}) / (coalesce(n{x}, 0)::DOUBLE + coalesce(t{x}, 0)::DOUBLE) ELSE q.p{x} END AS p{x}"
            for x in "ar"
        )
        levels.append(f"""
n{k} AS (SELECT state % {SYMBOLS ** (k + 1)} AS g, sum(a) AS a, sum(r) AS r FROM counts GROUP BY 1),
x{k} AS (SELECT g // {SYMBOLS} AS c, sum(a) AS na, sum(r) AS nr, count(*) FILTER (WHERE a > 0) AS ta, count(*) FILTER (WHERE r > 0) AS tr FROM n{k} GROUP BY 1),
e{k} AS ({every}),
p{k} AS (SELECT e.g, {ps} FROM e{k} e LEFT JOIN x{k} x ON x.c = e.c LEFT JOIN n{k} n ON n.g = e.g {lower}),
v{k} AS (SELECT g, round((ln(pa) - ln(pr)) * 1000000)::BIGINT AS v FROM p{k})""")
    return f"""
WITH u AS (
  SELECT row_number() OVER () AS row, page_id, translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path,
    regexp_replace(translate(coalesce(url, ''), '{FOLD_FROM}', '{FOLD_TO}'), '{FOLD_REST}', '_', 'g') AS symbols FROM pages),
r AS (SELECT *, CASE {rule} END AS rule, CASE {label} END AS label FROM u),
spots AS (SELECT row, label, symbols, unnest(generate_series(1, length(symbols))) AS i FROM r),
grams AS (SELECT row, label, ({state})::BIGINT AS state FROM (SELECT *, substr('{"@" * ORDER}' || symbols, i, {ORDER + 1}) AS w FROM spots)),
counts AS (SELECT state, count(*) FILTER (WHERE label = 'allow') AS a, count(*) FILTER (WHERE label = 'block') AS r FROM grams WHERE label IS NOT NULL GROUP BY 1),{",".join(levels)},
scored AS (
  SELECT row, sum(coalesce(h.v, l.v))::DOUBLE / count(*) / 1000000 AS score FROM grams g
  LEFT JOIN v{ORDER} h ON h.g = g.state JOIN v{ORDER - 1} l ON l.g = g.state % {SYMBOLS**ORDER} GROUP BY row),
b AS (SELECT r.*, floor(least(greatest(coalesce(score, 0.0), -20.0), 20.0) * 100)::BIGINT AS bin FROM r LEFT JOIN scored USING (row)),
bins AS (SELECT bin, count(*) FILTER (WHERE label = 'allow') AS a, count(*) FILTER (WHERE label = 'block') AS r FROM b GROUP BY bin),
rights AS (
  SELECT bin, round(1 - coalesce(sum(a) OVER below, 0)::DOUBLE / nullif(sum(a) OVER (), 0) + coalesce(sum(r) OVER below, 0)::DOUBLE / nullif(sum(r) OVER (), 0), 9) AS ok
  FROM bins WINDOW below AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT coalesce((SELECT bin FROM rights WHERE ok IS NOT NULL ORDER BY ok DESC, abs(bin), bin LIMIT 1), 0) AS cut)
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN bin >= cut THEN 'allow' ELSE 'block' END) AS verdict FROM b, cut"""


SQL = {
    "op1_url_filter": _urls(),
    "op4_secret_scan": _secrets(),
    "op2_mix_sources": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, {WORD})) END::BIGINT AS size,
    ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
fill AS (
  SELECT 1 AS round, source, source_size, weight, false AS capped, 0.0::DOUBLE AS target FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight, capped OR share > 2 * source_size,
    CASE WHEN capped OR share > 2 * source_size THEN 2.0 * source_size ELSE share END
  FROM (
    SELECT *, weight * (1.5 * sum(source_size) OVER () - sum(CASE WHEN capped THEN 2 * source_size ELSE 0 END) OVER ())
      / nullif(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER (), 0) AS share
    FROM fill) WHERE round <= (SELECT count(*) + 1 FROM s)),
t AS (SELECT source, source_size, target FROM fill WHERE round = (SELECT max(round) FROM fill)),
line AS (
  SELECT d.*, t.source_size, t.target, t.target / greatest(t.source_size, 1) AS each,
    sum(CASE WHEN d.size > 0 THEN 1 ELSE 0 END) OVER (
      PARTITION BY d.source ORDER BY floor(log2(d.size + 1) * 4), h % 32, d.size, h, doc_id) AS rank,
    ('0x' || substr(md5('start7|' || (d.source IS NOT NULL)::VARCHAR || '|' || coalesce(d.source, '')), 1, 8))::BIGINT
      / 4294967296.0::DOUBLE AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE
    size * least(floor(start + rank * each) - floor(start + (rank - 1) * each), ceil(each)) END::BIGINT AS taken
FROM line""",
    "op10_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op8_line_dedup": """
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
common AS (SELECT line FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 8),
k AS (
  SELECT doc_id, count(*) AS n_lines, count(c.line) AS n_removed,
    string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE c.line IS NULL) AS kept
  FROM t LEFT JOIN common c ON t.line = c.line GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op7_substring_dedup": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
win AS (
  SELECT doc_id, pos, word,
    CASE WHEN count(*) OVER ahead = 20 THEN md5(string_agg(word, ' ') OVER ahead) END AS h
  FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
dup AS (
  SELECT doc_id, pos, word,
    CASE WHEN h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) > 1 THEN 1 ELSE 0 END AS d
  FROM win),
gone AS (
  SELECT doc_id, pos, word, max(d) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS g
  FROM dup),
kept AS (
  SELECT doc_id, count(*) AS n_words, sum(g) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE g = 0) AS t
  FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
}
