"""DuckDB SQL for the text operators that SQL can express, over the same whole tables."""

from __future__ import annotations

from .mixing import BLOCK, GROUP_SHARDS, SHARD_WORDS
from .quality_rules import POLICIES, RULES, bits

_WORDS = r"[x for x in regexp_split_to_array(t, '[\x20\x09-\x0D]+') if x <> '']"


def quality_rules(policy: str) -> str:
    mask = " + ".join(f"(CASE WHEN {c} THEN {1 << i} ELSE 0 END)" for i, c in enumerate(RULES.values()))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS} AS w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(w) - 6)) AS u(i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
s AS (SELECT rid, least(8, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - 8)) AS n FROM r),
p AS (SELECT rid, sum(n) AS n FROM s GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    len([x for x in w if regexp_matches(x, '\p{{L}}')])::BIGINT AS n_letter_words, coalesce(p.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN p USING (rid)),
f AS (SELECT *, ({mask})::BIGINT AS fail_mask FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  fail_mask & {bits(POLICIES["base"])} <> 0 AS base_failed, fail_mask & {bits(POLICIES[policy])} = 0 AS kept, fail_mask
FROM f"""


def _seats(name: str, rows: str, share: str, seats: str, by: str, order: str) -> str:
    """All quotients of every row, ranked; a row's quota is how many are among the first ``seats``."""
    keys = f"{by}, {order}" if by else order
    part = f"PARTITION BY {by} " if by else ""
    return f"""
{name}_q AS (SELECT {keys}, {seats} AS n, row_number() OVER ({part}ORDER BY {share} / (2 * k + 1) DESC, {order}) AS r
  FROM {rows}, unnest(range(0, {seats}::BIGINT)) AS u(k) WHERE {share} > 0),
{name} AS (SELECT {keys}, count(*) AS quota FROM {name}_q WHERE r <= n GROUP BY ALL)"""


def source_mixing(seed: int = 42) -> str:
    return rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM z),
v AS (SELECT *, [3, 1, 2][(sid % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM n),
b AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
    coalesce(sum(cap) OVER h, 0) AS cap_before, coalesce(sum(weight) OVER h, 0) AS weight_before FROM v
  WINDOW h AS (ORDER BY cap::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap <= (total - cap_before) / (all_weight - weight_before) * weight AS capped FROM b),
e AS (SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS cap_done,
    sum(CASE WHEN capped THEN weight ELSE 0 END) OVER () AS weight_done FROM c),
t AS (
  SELECT source, sid, source_size, floor(total / {BLOCK} + 0.5)::BIGINT AS blocks,
    CASE WHEN capped THEN cap::DOUBLE ELSE weight * ((total - cap_done) / nullif(all_weight - weight_done, 0)) END AS target FROM e),
{_seats("sq", "t", "target", "blocks", "", "sid")},
x AS (
  SELECT d.*, t.sid, t.source_size, t.target, coalesce(sq.quota, 0) AS source_blocks,
    greatest(ceil(t.source_size::DOUBLE / {SHARD_WORDS})::BIGINT, 1) AS shards,
    ('0x' || substr(draw, 1, 7))::BIGINT AS d1, ('0x' || substr(draw, 8, 7))::BIGINT AS d2
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN sq USING (sid)),
y AS (SELECT *, (d1 % shards) % ceil(shards::DOUBLE / {GROUP_SHARDS})::BIGINT AS grp, d1 % shards AS shard FROM x),
gs AS (SELECT sid, grp, sum(size)::DOUBLE AS group_size, first(source_blocks) AS source_blocks FROM y GROUP BY ALL),
{_seats("gq", "gs", "group_size", "source_blocks", "sid", "grp")},
ss AS (SELECT sid, grp, shard, sum(size)::BIGINT AS shard_size FROM y GROUP BY ALL),
sg AS (SELECT ss.*, coalesce(gq.quota, 0) AS group_blocks FROM ss LEFT JOIN gq USING (sid, grp)),
{_seats("hq", "sg", "shard_size::DOUBLE", "group_blocks", "sid, grp", "shard")},
k AS (
  SELECT y.*, sg.shard_size, least(coalesce(hq.quota, 0) * {BLOCK}, 2 * sg.shard_size) AS read,
    coalesce(sum(size) OVER (PARTITION BY sid, grp, shard ORDER BY d2, draw, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM y JOIN sg USING (sid, grp, shard) LEFT JOIN hq USING (sid, grp, shard))
SELECT doc_id, size, source_size, target,
  (CASE WHEN shard_size = 0 THEN 0 ELSE (read // shard_size) * size
    + greatest(0, least(size, read % shard_size - before)) END)::BIGINT AS taken
FROM k"""


CHAT_FORMAT = """
WITH RECURSIVE u AS (
  SELECT conv_id, turn, 'c' || turn AS call_id, text, conv_id % 5 AS kind, conv_id % 7 AS fault,
    length(text) || CASE conv_id % 7 WHEN 3 THEN ' characters' ELSE '' END AS n_chars, count(*) OVER (PARTITION BY conv_id, turn) AS n_calls,
    row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(text)::VARCHAR NULLS FIRST, text NULLS FIRST) AS r
  FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL),
a AS (
  SELECT conv_id, turn, 'c' || (turn - 1) AS call_id, text, count(*) OVER (PARTITION BY conv_id, turn) AS n_results,
    row_number() OVER (PARTITION BY conv_id, turn ORDER BY text NULLS FIRST) AS r
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, turn, kind, count(*) OVER (PARTITION BY conv_id) AS calls FROM u WHERE r = 1),
d AS (
  SELECT conv_id, turn, turn - 2 AS needs, calls FROM c WHERE turn >= 2 AND kind <> 1
  UNION ALL SELECT conv_id, turn, turn + 2, calls FROM c WHERE kind IN (1, 2)),
k AS (SELECT d.*, c.turn IS NOT NULL AS known FROM d LEFT JOIN c ON c.conv_id = d.conv_id AND c.turn = d.needs),
w(conv_id, turn, y, steps) AS (
  SELECT conv_id, turn, needs, 1 FROM k WHERE known
  UNION SELECT w.conv_id, w.turn, k.needs, steps + 1 FROM w JOIN k ON k.conv_id = w.conv_id AND k.turn = w.y AND known WHERE steps < calls),
o AS (SELECT c.conv_id, c.turn, max(steps) >= any_value(calls) AS cyclic, max(y) AS latest, max(steps) AS chain
  FROM c JOIN w ON w.conv_id = c.conv_id AND w.turn = c.turn GROUP BY ALL),
m AS (SELECT conv_id, turn, count(*) AS unresolved FROM k WHERE NOT known GROUP BY ALL),
b AS (
  SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.call_id, a.call_id) AS call_id, n_calls, n_results,
    u.turn AS turn, u.text AS text, u.n_chars AS n_chars, u.fault AS fault, a.turn AS result_turn, a.text AS content
  FROM (SELECT * FROM u WHERE r = 1) u FULL JOIN (SELECT * FROM a WHERE r = 1) a USING (conv_id, call_id))
SELECT b.conv_id, b.call_id, coalesce(b.n_calls, 0)::BIGINT AS n_calls, coalesce(b.n_results, 0)::BIGINT AS n_results,
  CASE WHEN b.turn IS NULL THEN 'orphan' WHEN o.cyclic THEN 'cyclic' WHEN b.result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  concat_ws('; ', CASE WHEN b.turn IS NOT NULL AND (b.text IS NULL OR fault = 3) THEN 'n_chars: type' END,
    CASE fault WHEN 5 THEN 'tone: unknown' WHEN 4 THEN 'turn: missing' END) AS invalid,
  CASE WHEN NOT o.cyclic AND o.latest >= b.turn THEN o.latest ELSE coalesce(b.turn, b.result_turn) END::BIGINT AS release,
  CASE WHEN NOT o.cyclic AND o.latest >= b.turn THEN o.chain ELSE 0 END::BIGINT AS step, coalesce(m.unresolved, 0)::BIGINT AS unresolved,
  '{"arguments":' || CASE WHEN b.turn IS NULL THEN 'null' ELSE
    '{"n_chars":' || CASE WHEN fault = 3 THEN coalesce('"' || n_chars || '"', 'null') ELSE coalesce(n_chars, 'null') END
    || ',"text":' || coalesce(to_json(b.text)::VARCHAR, 'null') || CASE fault WHEN 5 THEN ',"tone":"plain"' ELSE '' END
    || CASE fault WHEN 4 THEN '' ELSE ',"turn":' || b.turn END || '}' END
    || ',"id":"' || b.call_id || '","name":' || CASE WHEN b.turn IS NULL THEN 'null' ELSE '"reply"' END
    || ',"result":' || coalesce(to_json(b.content)::VARCHAR, 'null') || '}' AS json
FROM b LEFT JOIN o ON o.conv_id = b.conv_id AND o.turn = b.turn LEFT JOIN m ON m.conv_id = b.conv_id AND m.turn = b.turn
"""


def substring_dedup(length: int) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
g AS (SELECT rid, i, array_to_string(w[i:i + {length - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {length - 2})) AS u(i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS c FROM g) WHERE c > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + {length})) AS p FROM r),
kept AS (
  SELECT d.rid, string_agg(w[p], ' ' ORDER BY p) AS t, count(*) AS n
  FROM d, unnest(range(1, len(w) + 1)) AS u(p) WHERE (d.rid, p) NOT IN (SELECT rid, p FROM gone) GROUP BY d.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, a byte and a bit at a time."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


def _encoded(column: str) -> str:
    text = f"({column})::VARCHAR"
    return f"coalesce(strlen({text})::VARCHAR || ':' || {text}, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_encoded(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


MERKLE_MANIFEST = f"""
WITH RECURSIVE
l AS (
  SELECT doc_id, coalesce('+' || lang, '') AS grp, {_leaf("n_chars")} AS leaf,
    CASE WHEN coalesce({_crc32("doc_id::VARCHAR")} % 7 = 0, false) THEN {_leaf("n_chars + 1")} END AS changed FROM documents),
leaves AS (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY grp) AS n FROM l),
t(grp, level, idx, n, digest) AS (
  SELECT grp, 0, idx, n, leaf FROM leaves
  UNION ALL SELECT grp, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM t WHERE n > 1
  GROUP BY grp, level, n, idx // 2),
roots AS (SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS groups FROM t WHERE n = 1),
g(level, idx, n, digest) AS (
  SELECT 0, place, groups, subroot FROM roots
  UNION ALL SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM g WHERE n > 1
  GROUP BY level, n, idx // 2),
way AS (
  SELECT rid, t.level AS level, (leaves.idx >> t.level) & 1 AS digit, s.digest AS sibling
  FROM leaves JOIN t ON t.grp = leaves.grp AND t.n > 1 AND t.idx = leaves.idx >> t.level
  LEFT JOIN t s ON s.grp = t.grp AND s.level = t.level AND s.idx = xor(t.idx, 1)
  UNION ALL
  SELECT rid, 1000 + g.level, (place >> g.level) & 1, s.digest
  FROM leaves JOIN roots USING (grp) JOIN g ON g.n > 1 AND g.idx = place >> g.level
  LEFT JOIN g s ON s.level = g.level AND s.idx = xor(g.idx, 1)),
path AS (SELECT rid, list({{'s': sibling, 'd': digit}} ORDER BY level) AS path, string_agg(sibling, '' ORDER BY level) AS siblings FROM way GROUP BY rid),
f AS (
  SELECT doc_id, leaf, subroot, (SELECT digest FROM g WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
    list_reduce(list_prepend({{'s': coalesce(changed, leaf), 'd': 0::BIGINT}}, coalesce(path, [])), lambda x, y: {{
      's': sha256(CASE y.d WHEN 1 THEN y.s || x.s ELSE x.s || coalesce(y.s, '') END), 'd': 0::BIGINT}}).s AS folded_root
  FROM leaves JOIN roots USING (grp) LEFT JOIN path USING (rid))
SELECT *, folded_root = root AS verified FROM f"""

# Without a search: the least (cost, audit) and the repaired turns for each last role (0 none, 1 system, 2 user, 3
# assistant), turn by turn. Inserts come before a turn; what is inserted at the end comes last.
_DUE = "CASE {0} WHEN 2 THEN 3 ELSE 2 END"
CONVERSATION_REPAIR = f"""
WITH RECURSIVE
c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c, range(2) r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
o AS (
  SELECT *, row_number() OVER w AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown, lag(left(role, 1)) OVER w AS before
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
e AS (
  SELECT *, CASE WHEN shown = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM o),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) AS rows,
    count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM e GROUP BY conv_id),
p(conv_id, i, state, best) AS (
  SELECT conv_id, 0::BIGINT, 0, {{'cost': 0, 'audit': '', 'text': []::VARCHAR[]}} FROM n
  UNION ALL
  SELECT conv_id, i + 1, state, min(best) FROM (
    SELECT x.conv_id, x.i, CASE edit WHEN 'D' THEN x.state WHEN 'R' THEN {_DUE.format("x.state")}
        ELSE CASE left(e.role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS state,
      {{'cost': x.cost + CASE edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN fault = 3 AND edit <> 'D' THEN 1 ELSE 0 END,
        'audit': x.audit || edit, 'text': CASE edit WHEN 'D' THEN x.text WHEN 'K' THEN list_append(x.text, e.role || ':' || e.text)
        ELSE list_append(x.text, CASE x.state WHEN 2 THEN 'assistant:' ELSE 'user:' END || e.text) END}} AS best
    FROM (
      SELECT conv_id, i, state, best.cost AS cost, best.audit AS audit, best.text AS text FROM p
      UNION ALL SELECT conv_id, i, {_DUE.format("state")}, best.cost + 2, best.audit || 'I',
        list_append(best.text, CASE state WHEN 2 THEN 'assistant:' ELSE 'user:' END) FROM p
      UNION ALL SELECT conv_id, i, CASE state WHEN 2 THEN 2 ELSE 3 END, best.cost + 4, best.audit || 'II', list_concat(best.text,
        CASE state WHEN 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END) FROM p) x
    JOIN e ON e.conv_id IS NOT DISTINCT FROM x.conv_id AND e.i = x.i + 1, (VALUES ('K'), ('R'), ('D')) v(edit)
    WHERE CASE WHEN edit = 'D' THEN true WHEN fault IN (1, 2) THEN false WHEN edit = 'R' THEN true
      WHEN left(e.role, 1) = 's' THEN x.state = 0 WHEN left(e.role, 1) = 'u' THEN x.state <> 2
      WHEN left(e.role, 1) = 'a' THEN x.state = 2 ELSE false END)
  GROUP BY conv_id, i, state),
z AS (
  SELECT conv_id, min(CASE state WHEN 1 THEN {{'cost': best.cost + 4, 'audit': best.audit || 'II', 'text': list_concat(best.text, ['user:', 'assistant:'])}}
    WHEN 2 THEN {{'cost': best.cost + 2, 'audit': best.audit || 'I', 'text': list_append(best.text, 'assistant:')}} ELSE best END) AS best
  FROM p JOIN n USING (conv_id) WHERE i = rows GROUP BY conv_id),
k AS (SELECT DISTINCT conv_id FROM conversations)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.text, chr(10)), '')) AS repaired_sha256
FROM k LEFT JOIN n USING (conv_id) LEFT JOIN z USING (conv_id)"""
