"""DuckDB SQL for the rows of the operators' queries that SQL can express.

The others need a seeded XXH64, a tokenizer, a trained model, or spans whose places in a text SQL's patterns do
not tell.
"""

from __future__ import annotations

from .licenses import DRIFT, LEAST, PHRASES, TEXTS
from .quality_rules import POLICIES, RULES, SYMBOLS, mask

_WORD = r"[^\x20\x09-\x0D]"

#: Each rule of the ledger as SQL over its measurements, in the order of the rules.
_FAILED = {
    "short": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "shouting": "10 * n_upper_words > 3 * n_words",
    "few_distinct_words": "n_distinct_words * n_distinct_words < 9 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "2 * word_chars < 4 * n_words",
}
_BITS = " | ".join(f"(CASE WHEN {_FAILED[rule]} THEN {1 << i} ELSE 0 END)" for i, rule in enumerate(RULES))

QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(text, '{_WORD}+') AS ws FROM d)),
g AS (SELECT r, i, w, lead(w, 1) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM w WINDOW x AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i, w, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS twice FROM g),
c AS (SELECT r, w, twice OR lag(twice, 1, false) OVER x OR lag(twice, 2, false) OVER x AS covered FROM t WINDOW x AS (PARTITION BY r ORDER BY i)),
words AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (WHERE covered) AS n_repeat_words,
    count(*) FILTER (WHERE strlen(w) > 1 AND regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]')) AS n_upper_words,
    count(DISTINCT w) AS n_distinct_words, max(strlen(w)) AS longest_word FROM c GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '{_WORD}') GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_upper_words, 0)::BIGINT AS n_upper_words,
    coalesce(n_distinct_words, 0)::BIGINT AS n_distinct_words, coalesce(longest_word, 0)::BIGINT AS longest_word
    FROM d LEFT JOIN words USING (r) LEFT JOIN lines USING (r)),
b AS (SELECT *, ({_BITS})::BIGINT AS fail_bits FROM m)
SELECT *, (fail_bits & {mask("v1")}) = 0 AS kept, {" OR ".join(f"({_FAILED[rule]})" for rule in POLICIES["base"])} AS base_failed FROM b
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest, n) END AS first FROM s),
k AS (SELECT *, CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
    refers_to, (CASE WHEN refers_to IS NULL THEN greatest(1, ceil(n / 65536)) ELSE 1 END)::INT AS chunks, true AS intact FROM k
"""

#: Counts of all documents less the scored document's own.
STUPID_BACKOFF = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(text, '{_WORD}+') AS ws FROM d)),
b AS (SELECT r, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS prev FROM w),
one AS (SELECT w, count(*) AS n FROM w GROUP BY 1 UNION ALL SELECT NULL, count(DISTINCT r) FROM w),
own_one AS (SELECT r, w, count(*) AS n FROM w GROUP BY 1, 2 UNION ALL SELECT r, NULL, 1 FROM w GROUP BY 1),
two AS (SELECT prev, w, count(*) AS n FROM b GROUP BY 1, 2),
own_two AS (SELECT r, prev, w, count(*) AS n FROM b GROUP BY 1, 2, 3),
a AS (SELECT r, count(*) AS own_all, sum(count(*)) OVER () AS n_all FROM w GROUP BY 1),
c AS (SELECT ot.r, ot.n AS times, two.n - ot.n AS n_pair, p.n - op.n AS n_before, greatest(q.n - oq.n, 1) AS n_word, greatest(n_all - own_all, 1) AS n_rest
    FROM own_two ot JOIN two ON two.w = ot.w AND two.prev IS NOT DISTINCT FROM ot.prev JOIN one p ON p.w IS NOT DISTINCT FROM ot.prev JOIN own_one op ON op.r = ot.r AND op.w IS NOT DISTINCT FROM ot.prev
    JOIN one q ON q.w = ot.w JOIN own_one oq ON oq.r = ot.r AND oq.w = ot.w JOIN a ON a.r = ot.r),
x AS (SELECT r, sum(times)::BIGINT AS n_words, sum(times * ln(CASE WHEN n_pair > 0 AND n_before > 0 THEN n_pair / n_before ELSE 0.4 * n_word / n_rest END)) AS score FROM c GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(score, 0.0), 6) AS log_score, round(score / n_words, 6) AS mean_log_score
FROM d LEFT JOIN x USING (r)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[0-9a-z\x{80}-\x{10FFFF}]+"
_TEMPLATES = ", ".join(f"({i}, '{label}', {i < len(PHRASES)}, '{text}')" for i, (label, text) in enumerate((*PHRASES, *TEXTS)))
_ROLLING = "lead(w, 1) OVER x AS w2, lead(w, 2) OVER x AS w3, lead(w, 3) OVER x AS w4"

LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS ws FROM documents),
w AS (SELECT r, i, w || ' ' || w2 AS pair, w || ' ' || w2 || ' ' || w3 || ' ' || w4 AS four FROM (SELECT *, {_ROLLING} FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d) WINDOW x AS (PARTITION BY r ORDER BY i))),
t AS (SELECT template, label, phrase, regexp_extract_all({_LOWER}, '{_TERM}') AS ws FROM (VALUES {_TEMPLATES}) v(template, label, phrase, text)),
g AS (SELECT template, label, phrase, i, CASE WHEN phrase THEN w || ' ' || w2 ELSE w || ' ' || w2 || ' ' || w3 || ' ' || w4 END AS gram
    FROM (SELECT *, {_ROLLING} FROM (SELECT template, label, phrase, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM t) WINDOW x AS (PARTITION BY template ORDER BY i))),
m AS (SELECT *, count(*) OVER (PARTITION BY template) AS grams FROM g WHERE gram IS NOT NULL),
hits AS (SELECT r, template, label, phrase, grams, w.i AS place, w.i - m.i AS diagonal FROM w JOIN m ON phrase AND gram = pair
    UNION ALL SELECT r, template, label, phrase, grams, w.i, w.i - m.i FROM w JOIN m ON NOT phrase AND gram = four),
voted AS (SELECT r, template, label, phrase, grams, diagonal, count(*) AS votes, min(place) AS first, max(place) AS last FROM hits GROUP BY ALL),
apart AS (SELECT *, CASE WHEN phrase OR coalesce(diagonal - lag(diagonal) OVER x > {DRIFT}, true) THEN 1 ELSE 0 END AS new FROM voted WINDOW x AS (PARTITION BY r, template ORDER BY diagonal)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM apart),
spans AS (SELECT r, template, label, phrase, grams, sum(votes) AS votes, min(first) AS first, max(last) AS last FROM numbered GROUP BY r, template, label, phrase, grams, span),
judged AS (SELECT *, phrase AND votes = grams AS place, NOT phrase AND last + 4 - first <= 2 * (grams + 3) AS verified, least(votes / grams, 1.0) AS share FROM spans),
s AS (SELECT r, count(*) FILTER (WHERE place) AS n_base, min(first) FILTER (WHERE place) AS first_word, max(first) FILTER (WHERE place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE place) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE place OR (verified AND share >= {LEAST})) AS labels, max(CASE WHEN place THEN 1.0 WHEN verified THEN share END) AS score, count(*) FILTER (WHERE verified AND share >= {LEAST}) AS n_spans FROM judged GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
    coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score, coalesce(n_spans, 0)::BIGINT AS n_spans FROM d LEFT JOIN s USING (r)
"""

def _edit(way: str, cost: str, initial: str) -> str:
    """A way, its cost in nine digits and then its audit, with one more edit."""
    return f"lpad((substr({way}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({way}, 10) || '{initial}'"


def _turn(state: str, initial: str, *before: str) -> str:
    """The best way to a state over a turn: it's deleted, or kept or re-roled from a state before."""
    kept = [f"CASE WHEN sound AND initial = '{initial}' THEN {_edit(b, 'more', 'K')} END" for b in before]
    rolled = [f"CASE WHEN sound THEN {_edit(b, '1 + more', 'R')} END" for b in before if initial != "s"]
    return f"list_min([{', '.join([_edit(state, '2', 'D'), *kept, *rolled])}])"


#: DuckDB has no crc32, so it's reckoned byte by byte. A row of way holds the best way to each state of the grammar, n before and w after inserts.
_CRC = "list_reduce([4294967295] || list_transform(string_split({0}, ''), lambda x: ord(x)), lambda c, b: xor(codes[(xor(c, b) & 255) + 1], c >> 8))"
_INSERTED = f"n0 AS w0, n1 AS w1, list_min([n2, {_edit('n0', '5', 'I')}, {_edit('n1', '5', 'I')}, {_edit('n3', '5', 'I')}]) AS w2, n3"
_AFTER_INSERTS = f"conv, i, w0, w1, w2, list_min([n3, {_edit('w2', '5', 'I')}]) AS w3"

CONVERSATIONS = f"""
WITH RECURSIVE codes AS (SELECT list(c ORDER BY i) AS codes FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
cased AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")}) % 20 AS n FROM conversations, codes),
damaged AS (SELECT conv_id, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role, CASE WHEN n = 1 THEN '' WHEN n = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN n = 3 THEN 2 ELSE 1 END)) AS copy FROM cased WHERE n <> 0),
keys AS (SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged JOIN keys ON damaged.conv_id IS NOT DISTINCT FROM keys.conv_id),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{_WORD}') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY i) AS before FROM placed),
t AS MATERIALIZED (SELECT *, fault NOT IN ('blank', 'duplicate') AS sound, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM judged),
way AS (SELECT {_AFTER_INSERTS} FROM (SELECT conv, i, {_INSERTED} FROM (SELECT conv, 0::BIGINT AS i, '000000000' AS n0, NULL::VARCHAR AS n1, NULL::VARCHAR AS n2, NULL::VARCHAR AS n3 FROM keys))
    UNION ALL SELECT {_AFTER_INSERTS} FROM (SELECT conv, i, {_INSERTED} FROM (SELECT t.conv, t.i, {_edit('w0', '2', 'D')} AS n0, {_turn('w1', 's', 'w0')} AS n1, {_turn('w2', 'u', 'w0', 'w1', 'w3')} AS n2, {_turn('w3', 'a', 'w2')} AS n3
        FROM way JOIN t ON t.conv = way.conv AND t.i = way.i + 1))),
best AS (SELECT conv, arg_max(list_min([w0, w3]), i) AS best FROM way GROUP BY conv),
edits AS (SELECT conv, j, edit, count(*) FILTER (WHERE edit <> 'I') OVER x AS i, count(*) FILTER (WHERE edit <> 'D') OVER x - 1 AS place FROM (SELECT conv, unnest(string_split(substr(best, 10), '')) AS edit, generate_subscripts(string_split(substr(best, 10), ''), 1) AS j FROM best)
    WINDOW x AS (PARTITION BY conv ORDER BY j)),
left_over AS (SELECT conv, j, place, edit, role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, max(CASE WHEN place = 0 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv) AS led FROM edits LEFT JOIN t USING (conv, i) WHERE edit NOT IN ('D', '')),
fixed AS (SELECT conv, count(*) AS n_repaired, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place + led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS said FROM left_over GROUP BY conv),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit, sha256(coalesce(said, '')) AS repaired_sha256, coalesce(n_repaired, 0)::BIGINT AS n_repaired FROM keys JOIN best USING (conv) LEFT JOIN counts USING (conv) LEFT JOIN fixed USING (conv)
"""

_TERMS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_FOLDED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LEXICAL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '{_TERMS}') AS ws FROM documents),
tf AS (SELECT r, {_FOLDED.format("w")} AS w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY ALL),
c AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d),
q AS (SELECT item_id, text, {_FOLDED.format("w")} AS w, count(*) AS times FROM (SELECT item_id, text, unnest(regexp_extract_all(text, '{_TERMS}')) AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
weighed AS (SELECT item_id, text, w, times * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight FROM q JOIN df USING (w), c),
m AS (SELECT r, doc_id, 75 + (25 * len(ws)::BIGINT * n_docs) // n_terms AS m FROM d, c WHERE len(ws) > 0),
s AS (SELECT item_id, text, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM weighed JOIN tf USING (w) JOIN m USING (r) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""

ORACLE_SQL: dict[str, str] = {"op2_quality_rules": QUALITY_RULES, "op4_warc": WARC, "op9_stupid_backoff": STUPID_BACKOFF, "op11_conversation_repair": CONVERSATIONS, "op12_lexical_search": LEXICAL, "op13_license_scan": LICENSES}
