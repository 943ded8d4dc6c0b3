"""DuckDB statements for operators that need more than a line or two of SQL to restate.

They share nothing with the operators but the fixed values of their contracts: windows and
shingles are lists of words, not hashes, and components come from a recursive query.
"""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP3_SQL = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS ls
  FROM documents),
windows AS (SELECT doc, unnest(range(1, len(ws) - 3)) AS i, ws FROM texts),
keyed AS (SELECT doc, i, array_to_string(ws[i:i + 4], ' ') AS w FROM windows),
twice AS (SELECT doc, i FROM (SELECT doc, i, count(*) OVER (PARTITION BY doc, w) AS n FROM keyed) WHERE n > 1),
covered AS (SELECT doc, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc, unnest(range(i, i + 5)) AS place FROM twice) GROUP BY doc),
counted AS (
  SELECT t.*, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters,
         len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1])) AS stutters
  FROM texts t LEFT JOIN covered c ON c.doc = t.doc),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_symbols > 5 * word_chars OR 2 * n_dup_lines > len(ls) OR 5 * stutters > n_words
                                OR 5 * letters < 2 * word_chars OR word_chars > 30 * n_words) AS kept
FROM based
"""

OP4_SQL = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '{WORD}') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3
    THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s
  FROM texts),
ranked AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id) AS n,
         row_number() OVER (PARTITION BY doc_id ORDER BY f, s) AS place
  FROM (SELECT *, count(*) OVER (PARTITION BY s) AS f FROM shingles)),
first_ones AS (SELECT * FROM ranked WHERE place <= n - (85 * n + 99) // 100 + 1),
candidates AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m
  FROM first_ones a JOIN first_ones b ON a.s = b.s AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
links AS (
  SELECT c.a, c.b FROM candidates c JOIN shingles x ON x.doc_id = c.a JOIN shingles y ON y.doc_id = c.b AND y.s = x.s
  GROUP BY c.a, c.b, c.n, c.m HAVING 100 * count(*) >= 85 * (c.n + c.m - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (
  SELECT a, a FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
least_of AS (SELECT node, min(other) AS least FROM reach GROUP BY node)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, t.doc_id) AS component_id,
       t.doc_id = coalesce(least, t.doc_id) AS kept
FROM texts t LEFT JOIN (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id) c ON c.doc_id = t.doc_id
LEFT JOIN least_of ON node = t.doc_id
"""

OP6_SQL = rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM texts),
keyed AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS w FROM windows),
lost AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS least FROM keyed) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM lost),
placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM texts),
rest AS (
  SELECT p.doc_id, count(*) FILTER (g.i IS NOT NULL) AS n_removed,
         string_agg(word, ' ' ORDER BY p.i) FILTER (g.i IS NULL) AS kept
  FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts t LEFT JOIN rest r ON r.doc_id = t.doc_id
"""

OP7_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda k:
           lpad(bin(('0x' || substr(sha1(html), k, 1))::INTEGER), 4, '0')), '') AS b
  FROM payloads)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
         16 * substr(b, 5 * k + 1, 1)::INTEGER + 8 * substr(b, 5 * k + 2, 1)::INTEGER + 4 * substr(b, 5 * k + 3, 1)::INTEGER
         + 2 * substr(b, 5 * k + 4, 1)::INTEGER + substr(b, 5 * k + 5, 1)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM bits
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8_SQL = rf"""
WITH items AS (
  SELECT item_id, ws, len(ws) AS size, least(5, len(ws)) AS k
  FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{WORD}') AS ws FROM benchmark) WHERE len(ws) > 0),
item_grams AS (
  SELECT item_id, size, k, gram, count(*) AS times
  FROM (SELECT item_id, size, k, unnest(list_transform(range(1, size - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS gram
        FROM items) GROUP BY ALL),
texts AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS ws FROM documents),
lengths AS (SELECT DISTINCT k FROM items),
doc_grams AS (
  SELECT doc_id, k, len(ws) AS words, unnest(range(0, len(ws) - k + 1)) AS place,
         unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS gram
  FROM texts, lengths WHERE len(ws) >= k),
shared AS (
  SELECT doc_id, item_id, size, d.k, times, gram, place, least(size, words) AS length, words
  FROM doc_grams d JOIN item_grams i USING (gram) WHERE d.k = i.k),
inside AS (
  SELECT *, unnest(range(greatest(0, place - (length - k)), least(place, words - length) + 1)) AS start_word FROM shared),
common AS (
  SELECT doc_id, item_id, start_word, size, k, length, sum(least(n, times)) AS c
  FROM (SELECT doc_id, item_id, start_word, size, k, length, gram, times, count(*) AS n FROM inside GROUP BY ALL) GROUP BY ALL),
alike AS (
  SELECT doc_id, item_id, start_word, length AS n_words, c::DOUBLE / ((length - k + 1) + (size - k + 1) - c) AS similarity FROM common)
SELECT doc_id, item_id, start_word::BIGINT AS start_word, n_words::BIGINT AS n_words, similarity
FROM alike WHERE 100 * similarity >= 80 - 1e-9
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start_word) = 1
"""

# A control string, with any backslashes after its first sign, grows by one backslash.
_CONTROL = (r"<\\*(?:\|(?:turn|end|im_start|im_end|endoftext|system|user|assistant)\|>|/?s>)|\[\\*/?INST\]")

OP13_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '{_CONTROL}'))
           + length('<|end|>') + 1)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

STATEMENTS = {"op3_quality_rules": OP3_SQL, "op4_minhash_near_dedup": OP4_SQL, "op6_substring_dedup": OP6_SQL,
              "op7_warc": OP7_SQL, "op8_decontamination": OP8_SQL, "op13_chat_formatting": OP13_SQL}
