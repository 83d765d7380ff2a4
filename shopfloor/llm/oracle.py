"""DuckDB SQL for the registered queries that SQL can express."""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"'[^\x20\x09-\x0D]+'"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, {_WORD}) AS words FROM d),
windows AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) > 2)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT place) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM d),
judged AS (
  SELECT *, trim(line, {_SPACE}) = '' AS blank, rtrim(line, {_SPACE} || '"''”’»)]') AS stem,
         length(regexp_replace(line, '[^|»›·•#*$%&<>{{}}]', '', 'g')) AS marks, lower(line) AS low
  FROM lines),
passed AS (
  SELECT *, blank OR (
    right(stem, 1) IN ('.', '!', '?', '…', ':', ';', '。', '！', '？')
    AND NOT (marks >= 3 AND marks * 20 >= length(line))
    AND NOT (length(line) <= 400 AND list_bool_or(list_transform(
      ['all rights reserved', 'alle rechte vorbehalten', 'tous droits réservés', 'todos los derechos reservados',
       'cookie', 'privacy policy', 'terms of use', 'terms of service', 'subscribe to our', 'newsletter',
       'enable javascript', 'requires javascript', 'lorem ipsum', 'click here', 'share this', 'log in to', 'sign up'],
      lambda n: contains(low, n))))) AS good
  FROM judged),
cleaned AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE good), '') AS clean,
         count(*) FILTER (WHERE NOT blank) - count(DISTINCT line) FILTER (WHERE NOT blank) AS n_dup_lines
  FROM passed GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
         CASE WHEN text = '' THEN 0 ELSE 1 - length(clean)::DOUBLE / length(text) END AS lost
  FROM w JOIN cleaned USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.4 AS kept
FROM counted
"""

OP6 = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
keyed AS (SELECT *, {_LOW.format(f"trim(line, {_SPACE})")} AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_CONTROL = r"'(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])'"


def _escaped_length(text: str) -> str:
    """Code points of an escaped text: a backslash more for each backslash
    and for each control string."""
    return (
        f"length({text}) + length({text}) - length(replace({text}, chr(92), ''))"
        f" + len(regexp_extract_all({text}, {_CONTROL}))"
    )


OP7 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]'))),
sized AS (
  SELECT *, length('<|im_start|>') + ({_escaped_length('role')}) + length('<|im_sep|>') + ({_escaped_length('text')})
         + length('<|im_end|>') + 1 AS chars
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

ORACLE: dict[str, str] = {"op5_quality_rules": OP5, "op6_line_dedup": OP6, "op7_chat_format": OP7}
