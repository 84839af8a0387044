"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from replyforge.llm.chat import CONTROL, END, TEXT, TURN


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _escaped_length(column: str) -> str:
    """Code points of a text after escaping: one more per backslash and control string."""
    marks = " + ".join(
        f"(length({column}) - length(replace({column}, {_text(m)}, ''))) // {len(m)}"
        for m in ("\\", *CONTROL)
    )
    return f"length({column}) + {marks}"


_LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, k, line, translate(
    trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents)
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, k, line, r.key IS NOT NULL AND l.doc_id <> r.keeper AS lost
  FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE lost)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT lost), ''))
    AS kept_sha256
FROM marked GROUP BY doc_id
"""

_REPLY_TREES = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'),
                   (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(
    string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), ''))
    AS loss_sha256,
  sum({len(TURN) + len(TEXT) + len(END)} + {_escaped_length("role")}
      + {_escaped_length("text")})::BIGINT AS formatted_chars
FROM given GROUP BY conv_id
"""

# Word k of a text is hit when a window that starts at most nine words before occurs.
_SUFFIX_ARRAYS = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, w[k:k + least(len(w), 10) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k
        FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), doc_windows AS (
  SELECT doc_id, k, size, w[k:k + size - 1] AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k
        FROM doc_words, (SELECT DISTINCT size FROM item_windows) WHERE len(w) >= size)
), hits AS (
  SELECT d.doc_id, d.k, d.size, i.item_id FROM doc_windows d JOIN item_windows i USING (win)
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

_FILTER_ORDERS = r"""
WITH given AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT t, min(doc_id) AS first_id FROM given GROUP BY t),
marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
  FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t)
      THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN first_id < doc_id THEN 16 ELSE 0 END AS m
  FROM given JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)
), counted AS (
  SELECT part, m, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM failed GROUP BY ALL
), letters AS (SELECT i, 1 << i AS bit, substr('ABCDE', i + 1, 1) AS letter FROM range(5) r(i)),
orders AS (
  SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits,
    a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, k::INT AS step, bits[k] AS bit,
    list_sum(list_prepend(0, bits[:k - 1]))::INT AS before
  FROM (SELECT *, unnest(range(1, 6)) AS k FROM orders)
), counts AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN m & before <> 0 AND m & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN m = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost
  FROM counted, steps GROUP BY ALL
)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counts
"""

SQL: dict[str, str] = {
    "op1_line_dedup": _LINE_DEDUP,
    "op3_reply_trees": _REPLY_TREES,
    "op7_suffix_arrays": _SUFFIX_ARRAYS,
    "op12_filter_orders": _FILTER_ORDERS,
}
