"""SQL of the operators whose statements are long: their own ways to the same results."""

from __future__ import annotations

#: CRC-32 has no function of its own: t is its table of bytes, and a value is a fold over the bytes of a text in hexadecimal.
_CRC_TABLE = "t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS t)"
_CRC_OF_X = "xor(list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"

SPELLING_VARIANTS = rf"""WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM r GROUP BY doc_id, w),
h AS (SELECT w, n, {_CRC_OF_X} AS h FROM d, t),
m AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM h),
v AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
g AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v),
x AS (SELECT w, n, i, left(w, i - 1) || substr(w, i + 1) AS k FROM g),
p AS (SELECT a.w, b.w AS v, b.n FROM x a JOIN x b ON a.k = b.k AND a.i = b.i AND a.w <> b.w
 UNION SELECT x.w, v.w, v.n FROM x JOIN v ON x.k = v.w UNION SELECT v.w, x.w, x.n FROM x JOIN v ON x.k = v.w),
b AS (SELECT w, count(*) AS n_near, max(n) AS m FROM p GROUP BY w),
f AS (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN m END AS form_n, CASE WHEN m >= 10 * v.n THEN (SELECT min(p.v) FROM p WHERE p.w = v.w AND p.n = m) END AS form FROM v LEFT JOIN b USING (w)),
c AS (SELECT w AS word, w AS root FROM f UNION SELECT c.word, f.form FROM c JOIN f ON f.w = c.root WHERE f.form IS NOT NULL),
e AS (SELECT c.word, c.root FROM c JOIN f ON f.w = c.root WHERE f.form IS NULL)
SELECT f.w AS word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN e ON e.word = f.w"""


def _edit(state: str, cost: str, letter: str, turn: str | None = None) -> str:
    """The way to a state (struct of cost, audit and turns), an edit longer."""
    said = f"{state}.o" if turn is None else f"{state}.o || chr(10) || {turn}"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {said}}} END"


def _keep(state: str, initial: str) -> str:
    return f"CASE WHEN open AND x = '{initial}' THEN {_edit(state, 'cut', 'K', 'role || chr(58) || text')} END"


def _rewrite(state: str, role: str) -> str:
    turn = f"'{role}:' || text"
    return f"CASE WHEN open THEN {_edit(state, '2 + cut', 'R', turn)} END"


def _new(state: str, role: str) -> str:
    return _edit(state, "2", "I", f"'{role}:'")


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


#: Ways to each state (0 nothing yet, 1 the system's turn, 2 the user's, 3 the assistant's) over one more row.
_MOVES = [
    [_edit("s0", "3", "D")],
    [_edit("s1", "3", "D"), _keep("s0", "s")],
    [_edit("s2", "3", "D"), *(_keep(s, "u") for s in ("s0", "s1", "s3")), *(_rewrite(s, "user") for s in ("s0", "s1", "s3"))],
    [_edit("s3", "3", "D"), _keep("s2", "a"), _rewrite("s2", "assistant")],
]

#: The best way to each state is carried from row to row.
CONVERSATION_REPAIR = rf"""WITH RECURSIVE {_CRC_TABLE},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS x FROM conversations),
k AS (SELECT c.*, {_CRC_OF_X} % 20 AS k FROM c, t),
d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS x, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS e FROM d),
f AS (SELECT *, CASE WHEN e = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN e NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair FROM o),
g AS (SELECT *, fault NOT IN ('b', 'd') AS open, CASE fault WHEN 't' THEN 1 ELSE 0 END AS cut FROM f),
r AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 'o': ''}} AS s0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, o VARCHAR)) AS s1, {{'c': 2, 'a': 'I', 'o': chr(10) || 'user:'}} AS s2, {{'c': 4, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3 FROM conversations
 UNION ALL SELECT conv_id, i, s0, s1, s2, {_least("s3", _new("s2", "assistant"))} FROM (SELECT conv_id, i, s0, s1, {_least("s2", *(_new(s, "user") for s in ("s0", "s1", "s3")))} AS s2, s3
 FROM (SELECT g.conv_id, g.i, {", ".join(f"{_least(*_MOVES[k])} AS s{k}" for k in range(4))} FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i + 1))),
e AS (SELECT conv_id, {_least("s0", "s3")} AS s FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(s.c AS BIGINT) AS cost, s.a AS audit, sha256(substr(s.o, 2)) AS repaired_sha256 FROM e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id"""

LINE_DEDUP = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT r, doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM u),
f AS (SELECT k, min(doc_id) AS first FROM k WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT r, doc_id, i, x, coalesce(doc_id > f.first, false) AS gone FROM k LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY r, doc_id"""
