"""DuckDB texts that the queries of this subpackage are compared with."""

from __future__ import annotations

from ledgerloom.llm import licenses
from ledgerloom.llm import quality_rules as rules

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def op4() -> str:
    names = list(rules.RULES)
    counts = rf"""
base AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
grams AS (SELECT r, i, list_aggregate(w[i:i + 2], 'string_agg', ' ') AS g FROM base, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS v(k) GROUP BY r),
counts AS (
  SELECT b.doc_id, b.r, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters,
    len(list_filter(w, lambda x: regexp_full_match(x, '\p{{L}}+[.,]?')))::BIGINT AS n_plain, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_shouts
  FROM base b LEFT JOIN repeated p USING (r)),
voted AS (SELECT *, (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEATED_PERCENT} * n_words) AS base_failed, {", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{j}" for j, (bad, good) in enumerate(rules.RULES.values()))} FROM counts)"""
    vs = [f"v{j}" for j in range(len(names))]
    steps = [
        counts,
        f"p0 AS MATERIALIZED (SELECT {', '.join(vs)}, count(*)::DOUBLE AS n, CASE WHEN least({', '.join(vs)}) = -1 THEN {rules.START_BAD} ELSE {rules.START_CLEAN} END::DOUBLE AS g FROM voted GROUP BY {', '.join(vs)})",
    ]
    for k in range(rules.ROUNDS):
        mass = lambda y, v, x: f"(sum(CASE WHEN {v} = {x} THEN {y} * n ELSE 0 END) + {rules.PSEUDO})"
        share = lambda y, v, x: f"ln({mass(y, v, x)} / ({mass(y, v, -1)} + {mass(y, v, 1)}))"
        bound = {-1: "least", 1: "greatest"}
        sums = ", ".join(f"{bound[x]}(0, {share('g', v, x)} - {share('(1 - g)', v, x)}) AS w{j}_{x + 1}" for j, v in enumerate(vs) for x in (-1, 1))
        prior = f"ln((sum(g * n) + {rules.PSEUDO}) / (sum(n) + 2 * {rules.PSEUDO})) - ln(1 - (sum(g * n) + {rules.PSEUDO}) / (sum(n) + 2 * {rules.PSEUDO})) AS w"
        score = " + ".join(["e.w", *(f"CASE {v} WHEN 1 THEN e.w{j}_2 WHEN -1 THEN e.w{j}_0 ELSE 0 END" for j, v in enumerate(vs))])
        steps += [f"e{k} AS MATERIALIZED (SELECT {prior}, {sums} FROM p{k})", f"p{k + 1} AS MATERIALIZED (SELECT {', '.join(vs)}, n, 1 / (1 + exp(-({score}))) AS g FROM p{k}, e{k} e)"]
    last = f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND g >= {rules.THRESHOLD}) AS kept FROM voted JOIN p{rules.ROUNDS} USING ({', '.join(vs)})"
    return "WITH " + ",\n".join(steps) + "\n" + last


OP7 = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '%', '%25'), chr(10), '%0A')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
FROM rows_ GROUP BY conv_id
"""


def op9() -> str:
    known = licenses.template_shingles(licenses.TEMPLATES)
    rows = ", ".join(f"('{name}', '{g}', {len(s)})" for name, s in known.items() for g in s)
    return rf"""
WITH t(name, g, n) AS (VALUES {rows}),
w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT r, list_aggregate(w[i:i + {licenses.SHINGLE - 1}], 'string_agg', ' ') AS g FROM w, unnest(range(1, len(w) - {licenses.SHINGLE - 2})) AS u(i)),
m AS (SELECT r, name FROM g JOIN t USING (g) GROUP BY r, name, n HAVING count(*) >= {licenses.CONTAINED} * n)
SELECT doc_id, count(name)::BIGINT AS n_licenses, coalesce(string_agg(name, ',' ORDER BY name), '') AS licenses FROM w LEFT JOIN m USING (r) GROUP BY r, doc_id
"""


OP11 = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
s AS (SELECT r, doc_id, i, md5(list_aggregate(w[i:i + 19], 'string_agg', ' ')) AS g FROM w, unnest(range(1, len(w) - 18)) AS u(i)),
later AS (SELECT r, i FROM s QUALIFY (row(doc_id, i) > min(row(doc_id, i)) OVER (PARTITION BY g))),
gone AS (SELECT DISTINCT r, i + k AS i FROM later, range(0, 20) AS v(k)),
lists AS (SELECT r, list(i) AS g FROM gone GROUP BY r),
cut AS (SELECT doc_id, w, coalesce(g, []) AS g, list_filter(w, lambda x, i: NOT list_contains(coalesce(g, []), i)) AS kept FROM w LEFT JOIN lists USING (r))
SELECT doc_id, len(w)::BIGINT AS n_words, len(g)::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM cut
"""


OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS fails FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS MATERIALIZED (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT o, array_to_string(list_transform(o, lambda x: chr((64 + x)::INT)), '') AS filter_order, step FROM o, unnest([1, 2, 3, 4, 5]) AS u(step)),
x AS (SELECT part, filter_order, step, o[step] AS filter, n, good, toxic, fails[o[step]] AS fails_it,
    coalesce(list_bool_or(list_transform(o[1:step - 1], lambda y: fails[y])), false) AS earlier, len(list_filter(fails, lambda y: y)) AS many FROM c, s),
r AS (SELECT part, filter_order, step, filter,
    coalesce(sum(n) FILTER (NOT earlier AND NOT fails_it), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT earlier AND fails_it), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (earlier AND fails_it), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails_it AND many = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT earlier AND fails_it), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT earlier AND fails_it), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM r
"""


OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
e AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM e GROUP BY ALL),
v AS MATERIALIZED (SELECT lang, term FROM e GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
z AS MATERIALIZED (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n FROM g JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
p AS MATERIALIZED (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER s + count(*) OVER s))::BIGINT AS p FROM z WINDOW s AS (PARTITION BY lang, source)),
q AS MATERIALIZED (SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)))::BIGINT AS q FROM z GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q),
both_ AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_ QUALIFY part = 'pair' OR rank <= 200
"""
