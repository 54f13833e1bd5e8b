"""SQL for the queries that it can express, written from their definitions for an independent engine."""

PLAIN_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LETTER_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

BEFORE = "OVER (ORDER BY size / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key, CAST(len({PLAIN_WORDS}) AS BIGINT) AS size FROM documents
),
sources AS (SELECT key, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS size FROM sized GROUP BY key),
weighed AS (
  SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM sources
),
filled AS (
  SELECT *, 3 * sum(size) OVER () AS total, coalesce(sum(2 * size) {BEFORE}, 0) AS used,
         sum(weight) OVER () - coalesce(sum(weight) {BEFORE}, 0) AS open FROM weighed
),
marked AS (SELECT *, 2 * size * 2 * open <= (total - 2 * used) * weight AS capped FROM filled),
targets AS (
  SELECT key, size AS source_size,
         CASE WHEN capped THEN CAST(2 * size AS DOUBLE)
              ELSE CAST((total - 2 * coalesce(sum(2 * size) FILTER (capped) OVER (), 0)) * weight AS DOUBLE)
                   / CAST(2 * sum(weight) FILTER (NOT capped) OVER () AS DOUBLE) END AS target,
         CAST('0x' || substr(md5('mix-1/' || key), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS start
  FROM marked
),
placed AS (
  SELECT doc_id, size, source_size, target, start, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY key ORDER BY size, md5(CAST(doc_id AS VARCHAR)), doc_id) AS place
  FROM sized JOIN targets USING (key)
)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(place * rate + start) - floor((place - 1) * rate + start), 2) AS BIGINT) * size AS taken
FROM placed
"""

SUBSTRINGS = f"""
WITH listed AS (SELECT doc_id, {PLAIN_WORDS} AS words FROM documents),
spans AS (
  SELECT doc_id, place, array_to_string(words[place:place + 19], ' ') AS span
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS place FROM listed)
),
later AS (
  SELECT doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY span ORDER BY doc_id, place) AS turn FROM spans)
  WHERE turn > 1
),
single AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM listed),
covered AS (
  SELECT s.*, coalesce(max(CASE WHEN l.place IS NOT NULL THEN 1 END)
                       OVER (PARTITION BY s.doc_id ORDER BY s.place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM single s LEFT JOIN later l ON s.doc_id = l.doc_id AND s.place = l.place
),
kept AS (
  SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (gone = 0) AS text
  FROM covered GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM listed LEFT JOIN kept USING (doc_id)
"""

TOP_K = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vector, c.vector) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
) WHERE place <= 5
"""

CONTAMINATION = f"""
WITH listed AS (SELECT doc_id, {LETTER_WORDS} AS words FROM documents),
items AS (SELECT item_id, words, least(10, len(words)) AS size FROM (SELECT item_id, {LETTER_WORDS} AS words FROM benchmark)
          WHERE len(words) > 0),
item_spans AS (
  SELECT item_id, size, array_to_string(words[place:place + size - 1], ' ') AS span
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS place FROM items)
),
doc_spans AS (
  SELECT doc_id, size, place, array_to_string(words[place:place + size - 1], ' ') AS span
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS place
        FROM listed, (SELECT DISTINCT size FROM items))
),
hits AS (SELECT DISTINCT doc_id, size, place, item_id FROM doc_spans JOIN item_spans USING (size, span)),
places AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + size)) AS word FROM hits)
           GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM listed LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
"""



def crc32(text: str) -> str:
    """The checksum of ASCII text, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {bits}), 4294967295)"


TRIE = f"""
WITH stored AS (
  SELECT conv_id, {crc32('CAST(conv_id AS VARCHAR)')} % 6 AS h,
         list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS turns
  FROM stored c LEFT JOIN stored b ON b.conv_id = c.conv_id - c.conv_id % 100
),
members AS (SELECT conv_id, depth, len(turns) = depth AS ends, turns[1:depth] AS node FROM (SELECT *, unnest(range(len(turns) + 1)) AS depth FROM built)),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ends
  FROM members GROUP BY node, depth
),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
subtrees AS (
  SELECT node[1:above] AS node, count(*) FILTER (n_children = 0) AS n_leaves,
         sum(CASE WHEN depth > 0 THEN (n_convs - 1) * length(node[depth].text) ELSE 0 END) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS above FROM whole) GROUP BY ALL
)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(w.ends, '')) AS ends_sha256
FROM whole w JOIN subtrees s USING (node) LEFT JOIN nodes p ON w.depth > 0 AND p.node = w.node[1:w.depth - 1]
"""

# Repair from the last row to the first: per state of ``(s?(ua)+)?`` the least (cost, letters, text that is left) of all that follows.
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GIVEN = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))


def way(cost: str, letter: str, line: str | None, rest: str) -> str:
    left = f"CASE WHEN {rest}.left = '' THEN {line} ELSE {line} || chr(10) || {rest}.left END" if line else f"{rest}.left"
    return f"{{'cost': {rest}.cost + {cost}, 'audit': '{letter}' || {rest}.audit, 'left': {left}}}"


def row_ways(state: int) -> str:
    keeps = " ".join(f"WHEN initial = '{x}' THEN {way('late', 'K', said, f's{to}')}" for x, to in MOVES[state].items() for said in ["role || ':' || text"])
    role, to = GIVEN[state]
    given = way("late + 1", "R", f"'{role}:' || text", f"s{to}")
    kept = f"list_filter([CASE WHEN NOT gone THEN CASE {keeps} END END, CASE WHEN NOT gone THEN {given} END], lambda x: x IS NOT NULL)"
    return f"list_min(list_concat([{way('2', 'D', None, f's{state}')}], {kept})) AS s{state}"


def inserted(source: str) -> str:
    return "SELECT conv, i, " + ", ".join(
        f"list_min([s{n}, {way('5', 'I', repr(role + ':'), f's{to}')}]) AS s{n}" for n, (role, to) in enumerate(GIVEN)
    ) + f" FROM ({source})"


STEP = f"SELECT conv, i - 1 AS i, {', '.join(row_ways(n) for n in range(4))} FROM ways JOIN marked USING (conv, i)"
NONE_LEFT = "{'cost': 0, 'audit': '', 'left': ''}"
REPAIR = f"""
WITH RECURSIVE filled AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations
),
kinds AS (SELECT *, {crc32("(conv || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM filled),
damaged AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, {BLANKS}) AS said, left(role, 1) AS initial FROM damaged
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS nth, lag(initial) OVER (PARTITION BY conv ORDER BY i) AS last_initial FROM placed
),
marked AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS late
  FROM ranked
),
counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND last_initial || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY conv
),
ways AS (
  SELECT conv, n AS i, {NONE_LEFT} AS s0, {{'cost': 10, 'audit': 'II', 'left': 'user:' || chr(10) || 'assistant:'}} AS s1,
         {{'cost': 5, 'audit': 'I', 'left': 'assistant:'}} AS s2, {NONE_LEFT} AS s3 FROM counted
  UNION ALL {inserted(inserted(inserted(STEP)))}
),
found AS (SELECT conv, s0 AS best FROM ways WHERE i = 0)
SELECT CASE WHEN conv <> ' ' THEN CAST(conv AS BIGINT) END AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(best.left, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv FROM filled) LEFT JOIN counted USING (conv) LEFT JOIN found USING (conv)
"""

STATEMENTS = {
    "op5_mixing": MIXING,
    "op6_substring_dedup": SUBSTRINGS,
    "op7_top_k": TOP_K,
    "op9_decontamination": CONTAMINATION,
    "op12_repair": REPAIR,
    "op13_prefix_trie": TRIE,
}
