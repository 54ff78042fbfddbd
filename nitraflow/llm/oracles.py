"""DuckDB SQL for the queries of this subpackage whose whole result SQL can express."""

from __future__ import annotations

from .collocations import PhraseRules
from .decontaminate import UNITS, WORDS, TemplateSettings
from .quality_rules import RepetitionRules

#: White space as everywhere in this subpackage, for a regular expression.
_WORD = r"[^\x20\x09-\x0D]+"

JACCARD = rf"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (
    SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END))) AS i FROM tokens)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 90 * (p.n + q.n - shared)
), edges AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reached AS (
  SELECT x AS doc_id, x AS other FROM edges UNION SELECT r.doc_id, e.y FROM reached r JOIN edges e ON e.x = r.other
), parts AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN parts p ON p.doc_id = d.doc_id
"""


def decontaminate_sql(s: TemplateSettings) -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)
    words = rf"""SELECT id, raw, pos, lower(raw) AS low, regexp_matches(raw, '^\p{{N}}') AS num, lag(regexp_matches(raw, '^\p{{N}}')) OVER (PARTITION BY id ORDER BY pos) AS after_num
    FROM (SELECT id, unnest(w) AS raw, generate_subscripts(w, 1) AS pos FROM (SELECT id, regexp_extract_all(text, '{WORDS}') AS w FROM _TABLE))"""
    kinds = f"""SELECT id, pos, low, CASE WHEN low IN ({units}) AND coalesce(after_num, false) THEN '#unit' WHEN low <> raw AND raw[2] <> upper(raw[2]) THEN '#name' WHEN num THEN '#num' ELSE low END AS kind FROM"""
    return rf"""
WITH item_words AS ({words.replace("_TABLE", "(SELECT item_id AS id, text FROM benchmark WHERE text IS NOT NULL)")}),
doc_words AS ({words.replace("_TABLE", "(SELECT DISTINCT text AS id, text FROM documents WHERE text IS NOT NULL)")}),
item_kinds AS ({kinds} item_words), doc_kinds AS ({kinds} doc_words),
items AS (
  SELECT id, n, CASE WHEN n > {2 * s.short_window} AND n <= {2 * s.window} THEN {min(s.short_window, s.window)} ELSE least(n, {s.window}) END AS size
  FROM (SELECT id, count(*) AS n FROM item_words GROUP BY id) WHERE n >= {s.least_words}
), item_lists AS (SELECT id, list(low ORDER BY pos) AS low, list(kind ORDER BY pos) AS kind FROM item_kinds GROUP BY id),
doc_lists AS (SELECT id, list(low ORDER BY pos) AS low, list(kind ORDER BY pos) AS kind FROM doc_kinds GROUP BY id),
item_windows AS (
  SELECT id AS item_id, size, n - size + 1 AS n_windows, ipos, low[ipos : ipos + size - 1] AS low, kind[ipos : ipos + size - 1] AS kind,
    len(list_filter(kind[ipos : ipos + size - 1], lambda x: x[1] = '#')) AS slots
  FROM (SELECT i.*, l.low, l.kind, unnest(generate_series(1, n - size + 1)) AS ipos FROM items i JOIN item_lists l USING (id))
), bench AS (
  SELECT item_id, size, n_windows, ipos, slots, true AS exact, low AS win FROM item_windows
  UNION ALL SELECT item_id, size, n_windows, ipos, slots, false, kind FROM item_windows WHERE 2 * slots <= size
), light_items AS (SELECT item_id, count(*) FILTER (2 * slots <= size) AS n_light FROM item_windows GROUP BY item_id),
doc_windows AS (
  SELECT id, size, dpos, exact, win FROM (
    SELECT id, size, dpos, true AS exact, low[dpos : dpos + size - 1] AS win FROM (SELECT *, unnest(generate_series(1, len(low) - size + 1)) AS dpos FROM doc_lists, (SELECT DISTINCT size FROM items))
    UNION ALL
    SELECT id, size, dpos, false, kind[dpos : dpos + size - 1] FROM (SELECT *, unnest(generate_series(1, len(kind) - size + 1)) AS dpos FROM doc_lists, (SELECT DISTINCT size FROM items)))
), hits AS (
  SELECT DISTINCT d.id, item_id, dpos, ipos, b.size, slots, b.exact, n_windows FROM doc_windows d JOIN bench b ON d.size = b.size AND d.exact = b.exact AND d.win = b.win
), tagged AS (SELECT *, false AS plain_only FROM hits UNION ALL SELECT *, true FROM hits WHERE exact),
places AS (SELECT DISTINCT plain_only, id, item_id, ipos, size FROM tagged),
words_held AS (
  SELECT plain_only, id, item_id, sum(least(size, coalesce(ipos - before, size))) AS words
  FROM (SELECT *, lag(ipos) OVER (PARTITION BY plain_only, id, item_id ORDER BY ipos) AS before FROM places) GROUP BY ALL
), lined AS (SELECT DISTINCT plain_only, id, item_id, ipos, size, dpos - ipos AS shift FROM tagged),
runs AS (
  SELECT plain_only, id, item_id, max(len) AS run_words FROM (
    SELECT plain_only, id, item_id, shift, run, count(*) + max(size) - 1 AS len FROM (SELECT *, ipos - row_number() OVER (PARTITION BY plain_only, id, item_id, shift ORDER BY ipos) AS run FROM lined) GROUP BY ALL)
  GROUP BY ALL
), counted AS (
  SELECT plain_only, id, item_id, count(DISTINCT ipos) AS n_windows, max(n_windows) AS item_windows, max(size) AS size, count(DISTINCT CASE WHEN 2 * slots <= size THEN ipos END) AS light FROM tagged GROUP BY ALL
), covered AS (
  SELECT * FROM (
    SELECT c.*, greatest(c.n_windows / item_windows, CASE WHEN n_light > 0 THEN light / n_light END) AS share, words / (item_windows + size - 1) AS held, run_words
    FROM counted c JOIN light_items USING (item_id) JOIN words_held USING (plain_only, id, item_id) JOIN runs USING (plain_only, id, item_id))
  WHERE share >= {s.coverage} OR held > {s.coverage} OR run_words >= {s.run_words}
), aligned AS (
  SELECT DISTINCT h.id, item_id, shift, ipos + k AS at FROM (SELECT h.*, dpos - ipos AS shift, unnest(generate_series(0, h.size - 1)) AS k FROM hits h JOIN covered c ON NOT plain_only AND c.id = h.id AND c.item_id = h.item_id WHERE slots > 0) h
), pairs AS (
  SELECT a.id, a.item_id, shift, i.kind, i.low AS item_value, d.low AS value FROM aligned a
  JOIN item_kinds i ON i.id = a.item_id AND i.pos = a.at AND i.kind[1] = '#' JOIN doc_kinds d ON d.id = a.id AND d.pos = a.at + shift AND d.kind = i.kind
), shifts AS (
  SELECT id, item_id, shift, count(*) AS n_slots, count(*) FILTER (item_value <> value) AS changed_slots,
    count(DISTINCT (kind, item_value, value)) = count(DISTINCT (kind, item_value)) AND count(DISTINCT (kind, item_value, value)) = count(DISTINCT (kind, value)) AS consistent
  FROM pairs GROUP BY ALL
), best AS (SELECT id, item_id, arg_max({{'n': n_slots, 'c': changed_slots, 'ok': consistent}}, (consistent, n_slots, -changed_slots, shift)) AS b FROM shifts GROUP BY ALL),
found AS (
  SELECT c.id, c.item_id, c.n_windows, c.item_windows, greatest(c.share, c.held) AS coverage, coalesce(b.n, 0) AS n_slots, coalesce(b.c, 0) AS changed_slots
  FROM covered c LEFT JOIN best USING (id, item_id) LEFT JOIN covered p ON p.plain_only AND p.id = c.id AND p.item_id = c.item_id
  WHERE NOT c.plain_only AND (b IS NULL OR b.ok OR p.id IS NOT NULL)
)
SELECT d.doc_id, f.item_id, n_windows::BIGINT AS n_windows, item_windows::BIGINT AS item_windows, coverage, n_slots::BIGINT AS n_slots, changed_slots::BIGINT AS changed_slots FROM documents d JOIN found f ON f.id = d.text
"""


def quality_sql(r: RepetitionRules) -> str:
    lengths = sorted({r.window, *(n for n, _ in r.ngram_limits)})
    windows = " UNION ALL ".join(f"SELECT doc_id, {n} AS n, i, w[i : i + {n - 1}] AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM tokens)" for n in lengths)
    bad = " OR ".join(f"coalesce(max(s.share) FILTER (s.n = {n}), 0) > {limit!r}" for n, limit in r.ngram_limits)
    return rf"""
WITH tokens AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
base AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM tokens
), windows AS ({windows}),
again AS (SELECT doc_id, n, unnest(list(i)) AS i FROM windows GROUP BY doc_id, n, win HAVING count(*) > 1),
inside AS (SELECT DISTINCT doc_id, n, unnest(generate_series(i, i + n - 1)) AS i FROM again),
shares AS (
  SELECT doc_id, n, count(*) AS words, sum(length(w[i])) / greatest(max(word_chars), 1) AS share FROM inside JOIN tokens USING (doc_id) JOIN base USING (doc_id) GROUP BY doc_id, n
), lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS k, list_sum(list_transform(regexp_extract_all(line, '{_WORD}'), lambda x: length(x))) AS chars
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM tokens) WHERE regexp_matches(line, '{_WORD}')
), dup AS (SELECT doc_id, count(*) FILTER (k > 1) AS n_dup_lines, coalesce(sum(chars) FILTER (k > 1), 0) AS dup_chars FROM lines GROUP BY doc_id),
judged AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(max(n_dup_lines), 0) AS n_dup_lines, coalesce(max(s.words) FILTER (s.n = {r.window}), 0) AS n_repeat_words,
    coalesce(max(dup_chars), 0) / greatest(word_chars, 1) > {r.line_limit!r} OR n_symbols > {r.symbols_per_word!r} * n_words OR {bad} AS bad
  FROM base b LEFT JOIN dup USING (doc_id) LEFT JOIN shares s USING (doc_id) GROUP BY doc_id, n_words, word_chars, n_symbols
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, n_words < {r.min_words} OR 100 * n_repeat_words > {r.window_percent} * n_words AS base_failed,
  NOT (n_words < {r.min_words} OR 100 * n_repeat_words > {r.window_percent} * n_words OR bad) AS kept FROM judged
"""


def collocations_sql(s: PhraseRules) -> str:
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents WHERE text IS NOT NULL
), grams AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS n
  FROM (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM pieces, (SELECT unnest(generate_series(1, {s.max_words})) AS size) WHERE len(w) >= size)
  GROUP BY ALL
), totals AS (SELECT lang, sum(n)::BIGINT AS n FROM grams WHERE size = 1 GROUP BY lang),
frequent AS (SELECT * FROM grams WHERE n >= {s.support}),
cuts AS (
  SELECT c.lang, c.phrase, c.n AS a, k, x.n AS l, y.n AS r, ((2000000::HUGEINT * c.n) // (x.n + y.n))::BIGINT AS score
  FROM (SELECT *, string_split(phrase, ' ') AS p, unnest(generate_series(1, size - 1)) AS k FROM frequent WHERE size > 1) c
  JOIN frequent x ON x.lang = c.lang AND x.size = k AND x.phrase = array_to_string(p[1 : k], ' ')
  JOIN frequent y ON y.lang = c.lang AND y.size = c.size - k AND y.phrase = array_to_string(p[k + 1 : c.size], ' ')
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), parts AS (
  SELECT lang, n, size, p, k, unnest(generate_series(1, size - k + 1)) AS i
  FROM (SELECT *, string_split(phrase, ' ') AS p, unnest(generate_series(2, size - 1)) AS k FROM frequent WHERE size > 2)
), longer AS (
  SELECT lang, array_to_string(p[i : i + k - 1], ' ') AS phrase, max(n) AS most FROM parts GROUP BY ALL
), ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank
  FROM weakest w LEFT JOIN longer o ON o.lang = w.lang AND o.phrase = w.phrase WHERE o.most IS NULL OR 100 * o.most < {s.cover_percent} * a
)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= {s.keep}
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": JACCARD, "op4_decontaminate": decontaminate_sql(TemplateSettings()), "op10_quality_rules": quality_sql(RepetitionRules()), "op12_collocations": collocations_sql(PhraseRules())}
