"""DuckDB SQL for the numbered queries that SQL expresses."""

from __future__ import annotations

from tanglemap.llm.chat import DEFAULT_TEMPLATE, ChatTemplate

A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _escaped(column: str, template: ChatTemplate) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in template.controls():
        out = f"replace({out}, {_text(control)}, {_text(control[0] + chr(92) + control[1:])})"
    return out


def chat_sql(template: ChatTemplate = DEFAULT_TEMPLATE, marked: str = "</s>[INST] ok [/INST]") -> str:
    around = " ".join(f"WHEN role = {_text(r)} THEN {len(a) + len(b)}" for r, (a, b) in template.turns.items())
    other = sum(map(len, template.other))
    loss = "role IN (" + ", ".join(map(_text, template.loss_roles)) + ")"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_text(marked)} UNION ALL SELECT -1, 1, 'assistant', {_text(marked)}),
x AS (SELECT *, length({_escaped("text", template)}) + CASE {around} ELSE {other} + length({_escaped("role", template)}) END AS chars,
        CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS mark FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN {loss} THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE {loss}), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) + {len(template.begin)} AS formatted_chars,
  regexp_full_match(string_agg(mark, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM x GROUP BY conv_id"""


def decontamination_sql(window: int = 10) -> str:
    words = r"regexp_extract_all(translate(text, " + A_TO_Z + r"), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce({words}, []) AS w FROM benchmark),
size AS (SELECT DISTINCT least({window}, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, least({window}, len(w)) AS n, unnest(range(1, len(w) - least({window}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0) AS s),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, size WHERE len(w) >= n) AS s),
met AS (SELECT doc_id, grams.n, i, item FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) AS s GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM met) AS s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id"""


def line_dedup_sql(tau: int = 2, per_edit: int = 6) -> str:
    return f"""
WITH RECURSIVE o AS (SELECT doc_id, CAST(i AS INT) - 1 AS no, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL) AS s),
named AS (SELECT *, trim(line) = '' AS blank FROM o),
l AS (SELECT DISTINCT line, length(line) AS n FROM named WHERE NOT blank AND length(line) >= {per_edit}),
e AS (SELECT a.line AS x, b.line AS y FROM l a JOIN l b ON b.n BETWEEN a.n AND a.n + {tau} AND a.line <> b.line
      AND abs(a.n - length(replace(a.line, 'e', '')) - b.n + length(replace(b.line, 'e', ''))) <= {tau} AND abs(length(replace(a.line, 't', '')) - a.n - length(replace(b.line, 't', '')) + b.n) <= {tau}
      AND levenshtein(a.line, b.line) <= least({tau}, a.n // {per_edit})),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT x, x AS y FROM both_ways UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.y),
cls AS (SELECT x AS line, min(y) AS class FROM reach GROUP BY x),
placed AS (SELECT named.doc_id, no, named.line, coalesce(class, named.line) AS class FROM named LEFT JOIN cls ON cls.line = named.line WHERE NOT blank),
ranked AS (SELECT *, row_number() OVER w AS r, first_value(line) OVER w AS kept FROM placed WINDOW w AS (PARTITION BY class ORDER BY doc_id, no)),
drops AS (SELECT doc_id, list_sort(list(no)) AS dropped, count(*) FILTER (WHERE line = kept) AS n_exact, count(*) FILTER (WHERE line <> kept) AS n_near FROM ranked WHERE r > 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, coalesce(dropped, []) AS dropped
FROM documents d LEFT JOIN drops ON drops.doc_id = d.doc_id"""


def jaccard_sql(k: int = 4, num: int = 85, den: int = 100) -> str:
    words = r"regexp_extract_all(translate(text, " + A_TO_Z + r"), '[^\x20\x09-\x0D]+')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {k} - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k} + 1, 1) + 1)) AS i FROM d WHERE len(w) > 0) AS x),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE {den} * both_have >= {num} * (a.n + b.n - both_have)),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT x, x AS y FROM both_ways UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.y),
c AS (SELECT x AS doc_id, min(y) AS component FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""


def spelling_sql(typo_every: int = 31, chars: int = 7, least: int = 2, times: int = 10) -> str:
    """CRC-32 is folded over the UTF-8 bytes by a table made from its polynomial; near words meet by
    what is left of them without one letter."""
    return f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc_table),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, unnest(regexp_extract_all(translate(text, {A_TO_Z}), '[a-z\u00C0-\u00FF]{{{chars},}}')) AS run FROM documents),
bytes AS (SELECT run, flatten(list_transform(string_split(id || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS b FROM runs),
hashed AS (SELECT run, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c // 256, crc_table[1 + xor(c % 256, x)])), 4294967295) AS h FROM bytes, t),
words AS (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % {typo_every} = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed) AS s WHERE length(word) >= {chars} GROUP BY word HAVING count(*) >= {least}),
less AS (SELECT word, n, length(word) AS len, i, left(word, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words) AS s),
near AS (SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.len = b.len AND a.word <> b.word
  UNION SELECT less.word, words.word, words.n FROM less JOIN words ON less.rest = words.word UNION SELECT words.word, less.word, less.n FROM less JOIN words ON less.rest = words.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS form_n FROM near GROUP BY word),
met AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.form_n >= {times} * words.n THEN near END AS form, CASE WHEN best.form_n >= {times} * words.n THEN best.form_n END AS form_n FROM words LEFT JOIN best ON best.word = words.word),
chain AS (SELECT word, word AS at FROM met UNION ALL SELECT chain.word, met.form FROM chain JOIN met ON met.word = chain.at WHERE met.form IS NOT NULL)
SELECT met.word, met.form, chain.at AS root, met.n, met.n_near, met.form_n FROM met JOIN chain ON chain.word = met.word JOIN met AS last ON last.word = chain.at WHERE last.form IS NULL"""
