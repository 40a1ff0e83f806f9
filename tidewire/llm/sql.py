"""DuckDB SQL of the results that SQL can express on whole tables."""

from __future__ import annotations

from tidewire.llm import rules

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP1 = rf"""WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
y AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS via FROM y UNION SELECT r.doc_id, y.b FROM r JOIN y ON r.via = y.a),
m AS (SELECT doc_id, min(via) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(coalesce(m.c, d.doc_id), d.doc_id) AS component_id, coalesce(m.c, d.doc_id) >= d.doc_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id"""


def _bounds(keys: str) -> str:
    """Quantiles of the sketches merged over ``keys``."""
    by = f"{keys}, rate" if keys else "rate"
    q = ", ".join(f"min(edge) FILTER (WHERE upto * 100 >= total * {p}) AS q{p}" for p in (10, 50, 90))
    return f"""SELECT {by}, max(total) AS total, {q} FROM (SELECT {by}, edge, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS total
  FROM (SELECT {by}, bucket, any_value(edge) AS edge, sum(n) AS n FROM k GROUP BY {by}, bucket)) GROUP BY {by}"""


def _drawn(a: str, b: str) -> str:
    return ", ".join(f"(({a}.total * {a}.{q} + {rules.SUPPORT} * {b}.{q}) / ({a}.total + {rules.SUPPORT}))::DOUBLE AS {q}" for q in ("q10", "q50", "q90"))


_SLACK = "CASE o.rate " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.RATES.items()) + " END"
OP5 = rf"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
v AS (SELECT r, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM g WHERE c > 1) GROUP BY r),
b AS (SELECT w.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN l USING (r) LEFT JOIN v USING (r)),
x AS (SELECT *, n_words < {rules.MIN_WORDS} OR {rules.REPEATED[1]} * n_repeat_words > {rules.REPEATED[0]} * n_words AS base_failed, n_symbols * 10000 // greatest(word_chars, 1) AS symbol_rate,
  n_dup_lines * 100000 // greatest(n_words, 1) AS line_rate, n_repeat_words * 10000 // greatest(n_words, 1) AS repeat_rate, word_chars * 100 // greatest(n_words, 1) AS word_length FROM b),
u AS (SELECT lang, source, unnest(['symbol_rate', 'line_rate', 'repeat_rate', 'word_length']) AS rate, unnest([symbol_rate, line_rate, repeat_rate, word_length]) AS v FROM x WHERE NOT base_failed),
z AS (SELECT *, CASE WHEN v < 16 THEN v ELSE 16 + (length(bin(v)) - 5) * 8 + (v >> (length(bin(v)) - 4)) - 8 END AS bucket FROM u),
k AS (SELECT lang, source, rate, bucket, CASE WHEN bucket < 16 THEN bucket ELSE ((bucket - 16) % 8 + 8) << ((bucket - 16) // 8 + 1) END AS edge, count(*) AS n FROM z GROUP BY ALL),
o AS ({_bounds("lang, source")}), ll AS ({_bounds("lang")}), cc AS ({_bounds("")}),
ww AS (SELECT l.lang, l.rate, {_drawn("l", "c")} FROM ll l JOIN cc c ON l.rate = c.rate),
h AS (SELECT o.lang, o.source, o.rate, {_drawn("o", "w")}, {_SLACK} AS slack FROM o JOIN ww w ON o.lang IS NOT DISTINCT FROM w.lang AND o.rate = w.rate),
j AS (SELECT x.r, bool_and(CASE h.rate WHEN 'symbol_rate' THEN symbol_rate WHEN 'line_rate' THEN line_rate WHEN 'repeat_rate' THEN repeat_rate ELSE word_length END <= q50 + {rules.SPREAD} * (q90 - q50) + slack
  AND (h.rate <> 'word_length' OR word_length >= q50 - {rules.SPREAD} * (q50 - q10) - slack)) AS ok
  FROM x JOIN h ON x.lang IS NOT DISTINCT FROM h.lang AND x.source IS NOT DISTINCT FROM h.source GROUP BY x.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(j.ok, TRUE) AS kept FROM x LEFT JOIN j USING (r)"""

OP7 = rf"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
s AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM s) WHERE c > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM d),
g AS (SELECT r, list(p) AS ps, count(*) AS n FROM c GROUP BY r),
k AS (SELECT r, p, ws[p] AS x FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM w) ANTI JOIN c USING (r, p)),
t AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept FROM k GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256 FROM w LEFT JOIN g USING (r) LEFT JOIN t USING (r)"""

# The pages of the driver's tables have one article element with paragraphs and a heading in it.
_BLOCK = "trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '[\\s\\p{Z}]+', ' ', 'g'))"
_PLAIN = f"replace(replace(replace(replace(regexp_replace({_BLOCK}, '&amp$', '&amp;'), '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
OP4 = f"""WITH b AS (SELECT page_id, url, regexp_split_to_array(replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '<br>', ' '), '</?(?:p|h1)>') AS bs FROM pages),
t AS (SELECT page_id, url, coalesce(array_to_string(list_filter(list_transform(bs, lambda x: {_PLAIN}), lambda x: x <> ''), chr(10)), '') AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t"""

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12 = rf"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all({_LOWER.format("text")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS ws FROM benchmark),
s AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS n, greatest(sum(len(ws)), 1)::BIGINT AS l FROM w),
q AS (SELECT q, unnest(ws) AS x FROM b),
p AS (SELECT r, x, count(*) AS tf FROM (SELECT r, unnest(ws) AS x FROM w) WHERE x IN (SELECT x FROM q) GROUP BY ALL),
d AS (SELECT x, floor(1000 * ln((2.0::DOUBLE * n + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM (SELECT x, count(*) AS df FROM p GROUP BY x), s),
v AS (SELECT r, x, d.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * len(ws)::HUGEINT * n) // l)::BIGINT))) AS v FROM p JOIN d USING (x) JOIN w USING (r), s),
t AS (SELECT q, r, sum(v)::BIGINT AS score FROM q JOIN v USING (x) GROUP BY ALL HAVING sum(v) > 0),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST, r)::INTEGER AS rank FROM t JOIN w USING (r))
SELECT item_id, rank, doc_id, score FROM k JOIN b USING (q) WHERE rank <= 50"""

_P = "(1 + (1000000000::HUGEINT * ({0} + 1)) // ({1} + {2}))::BIGINT"
OP13 = rf"""WITH w AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-z\x{{80}}-\x{{10FFFF}}]+')) AS x FROM documents),
k AS (SELECT lang, x, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM k GROUP BY lang),
c AS (SELECT w.lang, source, x, count(*) AS n FROM w SEMI JOIN k ON w.lang = k.lang AND w.x = k.x GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(t.n, 0)::BIGINT AS total, coalesce(v.v, 0) AS v, coalesce(v.n, 0) AS n FROM (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents) d
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) t ON d.lang = t.lang AND d.source = t.source LEFT JOIN v ON d.lang = v.lang),
p AS (SELECT g.lang, g.source, k.x, coalesce(c.n, 0) AS n, {_P.format("coalesce(c.n, 0)", "g.total", "g.v")} AS p, {_P.format("k.n", "g.n", "g.v")} AS q
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.x = k.x),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.x = b.x AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', x, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM u)
SELECT * FROM z WHERE part = 'pair' OR rank <= 200"""

SQL = {"op13_source_divergence": OP13, "op12_ranked_search": OP12, "op4_html_extraction": OP4, "op1_minhash_near_dedup": OP1, "op5_quality_rules": OP5, "op7_substring_dedup": OP7}
