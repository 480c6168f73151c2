"""SQL that gives the rows of the queries which SQL can express."""

from __future__ import annotations

from sillage.llm import fmindex, repetition

_LOWER = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN, _ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str, pattern: str, lower: bool = True) -> str:
    return f"regexp_extract_all({_LOWER.format(t=text) if lower else f'''coalesce({text}, '')'''}, '{pattern}')"


JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words('text', _PLAIN)} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS t FROM d),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS (SELECT x, y, c = n1.n AND c = n2.n AS same FROM shared JOIN n n1 ON n1.doc_id = x JOIN n n2 ON n2.doc_id = y WHERE 100 * c >= 90 * (n1.n + n2.n - c)),
  reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
  least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, least(doc_id, coalesce((SELECT min(y) FROM links WHERE links.x = documents.doc_id AND same), doc_id)) AS class_id
  FROM documents LEFT JOIN n USING (doc_id) JOIN least ON least.x = doc_id"""


def _windows() -> str:
    limits = repetition.WINDOW_LIMITS
    least = min(limits)
    seen = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS n, i, count(*) OVER same AS many, row_number() OVER (same ORDER BY i) AS nth FROM (SELECT doc_id, i, w[i:i + {n - 1}] AS g FROM d, unnest(range(1, len(w) - {n - 2})) u(i)) WINDOW same AS (PARTITION BY doc_id, g)"
        for n in limits
    )
    over = " OR ".join(f"coalesce(chars_{n}, 0) > {limit}::DOUBLE * word_chars" for n, limit in limits.items())
    covered = ", ".join(f"CAST(sum(CASE WHEN n = {n} THEN len(w[j]) END) AS BIGINT) AS chars_{n}" for n in limits)
    chars = ", ".join(f"coalesce(chars_{n}, 0) AS chars_{n}" for n in limits)
    line_words = "len(array_to_string(regexp_extract_all(line, '" + _PLAIN + "'), ''))"
    return f"""WITH d AS (SELECT doc_id, text, {_words('text', _PLAIN, lower=False)} AS w FROM documents),
  seen AS ({seen}),
  repeated AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {least})) AS j FROM seen WHERE n = {least} AND many > 1) GROUP BY doc_id),
  later AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS j FROM seen WHERE nth > 1),
  covered AS (SELECT doc_id, {covered} FROM later JOIN d USING (doc_id) GROUP BY doc_id),
  lines AS (SELECT doc_id, k, lines[k] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM d), unnest(range(1, len(lines) + 1)) u(k) WHERE regexp_matches(lines[k], '{_PLAIN}')),
  again AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup_lines, CAST(coalesce(sum(CASE WHEN nth > 1 THEN {line_words} END), 0) AS BIGINT) AS dup_line_chars
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth FROM lines) GROUP BY doc_id),
  counts AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, {chars}
    FROM d LEFT JOIN again USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN covered USING (doc_id)),
  judged AS (SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.REPEATED_PERCENT} * n_words AS base_failed FROM counts)
  SELECT *, NOT base_failed AND NOT ((n_lines >= {repetition.LINE_LIMIT_FROM} AND n_dup_lines > {repetition.LINE_LIMIT}::DOUBLE * n_lines) OR dup_line_chars > {repetition.LINE_CHARS_LIMIT}::DOUBLE * word_chars OR {over}) AS kept FROM judged"""


REPETITION = _windows()

_W = fmindex.WINDOW
DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_words('text', _ALNUM)} AS w FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text', _ALNUM)} AS w FROM benchmark),
  win AS (SELECT DISTINCT item, w[i:i + {_W - 1}] AS g, least(len(w), {_W}) AS n FROM b, unnest(range(1, greatest(len(w) - {_W - 1}, 1) + 1)) u(i) WHERE len(w) > 0),
  pos AS (SELECT doc_id, i, n, w[i:i + n - 1] AS g FROM d, (SELECT DISTINCT n FROM win) l, unnest(range(1, len(w) - n + 2)) u(i)),
  occ AS (SELECT DISTINCT doc_id, i, n, item FROM pos JOIN win USING (n, g)),
  hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM occ) GROUP BY doc_id),
  items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM occ GROUP BY doc_id)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEXICAL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words('text', _TERM)} AS w FROM documents),
  q AS (SELECT DISTINCT item_id, unnest({_words('text', _TERM)}) AS t FROM benchmark),
  tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
  total AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
  weight AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, total GROUP BY t),
  part AS (SELECT r, t, weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(d.w) * n_docs) // n_terms))) AS s FROM tf JOIN d USING (r) JOIN weight USING (t), total),
  scored AS (SELECT item_id, r, CAST(sum(s) AS BIGINT) AS score FROM q JOIN part USING (t) GROUP BY item_id, r HAVING sum(s) > 0),
  ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored JOIN d USING (r))
  SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""

_DIGEST = "sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)"


def _escaped(column: str, role: bool = False) -> str:
    backslashes, slashes = f"length({column}) - length(replace({column}, '\\', ''))", f"(length({column}) - length(replace({column}, '</', ''))) // 2"
    signs = f"coalesce(list_sum(list_transform(regexp_extract_all({column}, '#{{3,}}'), lambda x: length(x) - 2)), 0)"
    return f"length({column}) + {backslashes} + {slashes} + {signs}" + (f" + (length({column}) - length(replace({column}, ': ', ''))) // 2" if role else "")


CHAT = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, u, CASE u WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) v(u)),
  o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_DIGEST}) AS pos FROM t),
  c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS said,
      coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '') AS learned,
      CAST(sum(4 + {_escaped('role', role=True)} + 2 + {_escaped('text')} + 8) AS BIGINT) AS formatted_chars FROM o GROUP BY conv_id)
  SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM c"""

_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, i: xor(c >> 1, 3988292384::BIGINT * (c & 1)))), 4294967295)"
)
TRIE = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  own AS (SELECT conv_id, CAST({_CRC} % 4 AS BIGINT) AS h, list({_DIGEST} ORDER BY turn NULLS FIRST, {_DIGEST}) AS turns,
      list(len(regexp_extract_all(text, '{_PLAIN}')) ORDER BY turn NULLS FIRST, {_DIGEST}) AS words FROM t GROUP BY conv_id),
  built AS (SELECT own.conv_id, list_concat(coalesce(base.turns[1:own.h], []), own.turns[own.h + 1:]) AS turns, list_concat(coalesce(base.words[1:own.h], []), own.words[own.h + 1:]) AS words
    FROM own LEFT JOIN own base ON base.conv_id = own.conv_id - own.conv_id % 20),
  m AS (SELECT conv_id, d, turns[1:d] AS node, turns[1:d - 1] AS parent, len(turns) = d AS ends, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words FROM built, unnest(range(0, len(turns) + 1)) u(d)),
  n AS (SELECT node, d AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, CAST((count(*) - 1) * any_value(words) AS BIGINT) AS saved,
      coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ended FROM m GROUP BY node, d),
  k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent),
  below AS (SELECT DISTINCT a.node, b.node AS under FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.d >= a.d),
  sums AS (SELECT below.node, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves FROM below JOIN n ON n.node = below.under LEFT JOIN k ON k.node = below.under GROUP BY below.node)
  SELECT n.conv_id, depth, CASE WHEN depth > 0 THEN p.conv_id END AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(ended) AS ends_sha256
  FROM n LEFT JOIN (SELECT node, conv_id FROM n) p ON p.node = n.parent LEFT JOIN k ON k.node = n.node JOIN sums ON sums.node = n.node"""
