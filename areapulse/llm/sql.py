"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from areapulse.llm.quality_rules import BOILERPLATE, MENU, LineRules
from areapulse.llm.secret_scan import BASE_RULES, MORE_RULES, Rule

SQL: dict[str, str] = {}

_SP = r"[\x20\x09-\x0D]"
_R = LineRules()


def _n(text: str) -> str:
    """Number of words."""
    return rf"len(regexp_extract_all({text}, '[^\x20\x09-\x0D]+'))"


def _found(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_END = r"""[.!?:;…。！？,\"”’»'')\]]""" + _SP + r"*\z"

SQL["op1_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
g2 AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS x FROM g),
g3 AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM g2) WHERE c >= 2),
g4 AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM
       (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM g3) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
lf AS (SELECT r, line, {_n('line')} AS n,
         {_found('line', r'[#*$%&<>{}\\^~=]+|!!+')} AS marks, {_found('line', '[|»›•·▸→]')} AS bars,
         regexp_matches(line, '{_END}') AS ends,
         regexp_matches(line, '(?i)^{_SP}*(({MENU}){_SP}*)+\z') AS menu,
         regexp_matches(line, '(?i){"|".join(BOILERPLATE)}') AS known FROM l),
lk AS (SELECT r, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dups,
         sum(n) FILTER (NOT (n > 0 AND (marks * 100 > n * {_R.marks_per_100} OR (n <= {_R.stub_words} AND NOT ends)
           OR bars * 100 > n * {_R.separators_per_100} OR menu OR known))) AS clean FROM lf GROUP BY r),
c AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '{_SP}', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        dups::BIGINT AS n_dup_lines, coalesce(g4.n, 0)::BIGINT AS n_repeat_words, coalesce(clean, 0)::BIGINT AS n_clean_words
      FROM d JOIN w USING (r) JOIN lk USING (r) LEFT JOIN g4 USING (r))
SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed,
  NOT (n_words < 10 OR n_repeat_words * 100 > n_words * 20 OR (n_words - n_clean_words) * 100 > n_words * {_R.lost_per_100}) AS kept
FROM c
"""

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL["op8_decontaminate"] = rf"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, '{_AZ}', '{_AZ.lower()}'), '{_ALNUM}') AS ws FROM benchmark
           WHERE item_id IS NOT NULL AND text IS NOT NULL),
bl AS (SELECT item_id, ws, least(13, len(ws)) AS m FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i+m-1], ' ') AS x
       FROM (SELECT item_id, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM bl)),
d AS (SELECT doc_id, row_number() OVER () AS r,
        regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '{_ALNUM}') AS ws FROM documents),
dw AS (SELECT r, m, i, array_to_string(ws[i:i+m-1], ' ') AS x
       FROM (SELECT r, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(ws) >= m)),
h AS (SELECT r, i, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.x = bw.x),
p AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS w FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks
       FROM (SELECT DISTINCT r, item_id::VARCHAR AS k FROM h) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ks, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN it USING (r)
"""

SQL["op3_source_mix"] = rf"""
WITH d AS (SELECT doc_id, source, {_n("coalesce(text, '')")}::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM s0),
s2 AS (SELECT *, [5, 2, 1][(idx % 3 + 1)::INT] AS weight, source_size * 2 AS cap FROM s1),
s3 AS (SELECT *, cap::DOUBLE / weight AS ratio FROM s2),
s4 AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 3 / 2 - coalesce(sum(cap) OVER e, 0)::DOUBLE)
                 / (sum(weight) OVER () - coalesce(sum(weight) OVER e, 0))::DOUBLE AS lev
       FROM s3 WINDOW e AS (ORDER BY ratio, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s5 AS (SELECT *, max(CASE WHEN ratio > lev THEN lev END) OVER () AS level FROM s4),
s6 AS (SELECT source, source_size, idx, CASE WHEN ratio > level THEN level * weight ELSE cap::DOUBLE END AS target FROM s5),
s AS (SELECT *, sum(floor(target)::BIGINT) OVER (ORDER BY idx)::BIGINT AS hi, sum(floor(target)::BIGINT) OVER ()::BIGINT AS al,
        floor(target)::BIGINT AS whole FROM s6),
p AS (SELECT (coalesce(sum(size), 0)::BIGINT * 3 + 1) // 2 AS b, 16 AS blk FROM d),
k AS (SELECT unnest(range(CASE WHEN b > 0 THEN (b + blk - 1) // blk + 64 ELSE 0 END)) AS k FROM p),
x AS (SELECT k, k::DOUBLE * 0.6180339887498949 - floor(k::DOUBLE * 0.6180339887498949) AS x FROM k),
s7 AS (SELECT idx, source_size, whole, row_number() OVER (PARTITION BY idx ORDER BY k) - 1 AS r
       FROM x JOIN s ON x * al >= hi - whole AND x * al < hi),
sh AS (SELECT idx, source_size, whole, coalesce(given, 0) AS given,
        (whole // source_size) * ((source_size + blk - 1) // blk) + (whole % source_size + blk - 1) // blk AS needed
       FROM s LEFT JOIN (SELECT idx, count(*) AS given FROM s7 GROUP BY idx) USING (idx), p WHERE whole > 0),
sl AS (SELECT * FROM s7
       UNION ALL SELECT idx, source_size, whole, unnest(range(given, needed)) FROM sh WHERE given < needed),
bl AS (SELECT idx, r % nb AS b, least(blk, whole - ((r // nb) * source_size + (r % nb) * blk)) AS take
       FROM (SELECT *, (source_size + blk - 1) // blk AS nb FROM sl, p)),
o AS (SELECT d.*, idx, source_size, target,
        coalesce(sum(size) OVER (PARTITION BY idx ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off,
        row_number() OVER () AS row
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
pc AS (SELECT row, idx, off, size, blk, unnest(range(off // blk, (off + size - 1) // blk + 1)) AS b FROM o, p WHERE size > 0),
t AS (SELECT row, sum(greatest(0, least(take - (greatest(off, pc.b * blk) - pc.b * blk),
                 least(off + size, (pc.b + 1) * blk) - greatest(off, pc.b * blk)))) AS taken
      FROM pc JOIN bl ON bl.idx = pc.idx AND bl.b = pc.b WHERE take > 0 GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM o LEFT JOIN t USING (row)
"""


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _rule(rule: Rule, order: int) -> str:
    """Spans of one rule: lengths of the parts between matches and of the matches add up to the starts."""
    p = _quoted(rule.pattern)
    return rf"""
SELECT r, '{rule.kind}' AS kind, {order} AS o, s, s + length(m[i]) AS e FROM (
  SELECT r, m, p, i, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
                     + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s FROM (
    SELECT r, m, p, g, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT r, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {rule.group}) AS p, string_split_regex(t, '{p}') AS g FROM d)))
WHERE length(p[i]) >= {rule.least}"""


_RULES = " UNION ALL ".join(_rule(r, i) for i, r in enumerate(BASE_RULES + MORE_RULES))

SQL["op2_secret_scan"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
f AS ({_RULES}),
a AS (SELECT r, count(*) FILTER (o = 0) AS n0, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2,
        string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, o) FILTER (o < 3) AS base,
        string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, o) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""

SQL["op11_middle_fill"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_SP}*[^\x20\x09-\x0D]+|{_SP}+') AS u,
        list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(x, i, 8))::BIGINT) AS h FROM d),
c AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a,
        greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
             WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM w),
s AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a+1:b], '') AS m, array_to_string(u[b+1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM s
"""

# crc32 by its table, which follows from the polynomial.
_TABLE = """tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab)"""
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], {bytes}),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"""

# Grams of four words, windows of four hashes; the smallest, of equal ones the rightmost.
SQL["op12_winnowing"] = rf"""
WITH {_TABLE},
d0 AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS r, coalesce(text, '') AS t FROM documents),
d AS (SELECT doc_id, r, t, coalesce(lead(t) OVER (ORDER BY r), first_value(t) OVER (ORDER BY r)) AS nt FROM d0),
e AS (SELECT *, substr(t, 1, length(t) - length(t) // 2) || substr(nt, 1, length(t) // 2) AS ed FROM d),
x AS (SELECT r, 0 AS kind, t AS x FROM e UNION ALL SELECT r, 1, ed FROM e),
w AS (SELECT r, kind, i, ws[i] AS w FROM (SELECT r, kind, ws, unnest(range(1, len(ws) + 1)) AS i
        FROM (SELECT r, kind, regexp_extract_all(x, '[^ 	-]+') AS ws FROM x))),
b AS (SELECT w, list_transform(range(length(hex(w)) // 2), lambda i: ('0x' || substr(hex(w), (2 * i + 1)::INT, 2))::BIGINT) AS bytes
      FROM (SELECT DISTINCT w FROM w)),
c AS (SELECT w, {_CRC.format(bytes="bytes")} % 536870909 AS c FROM b, tab),
g AS (SELECT r, kind, i, count(*) OVER (PARTITION BY r, kind) AS n, (c * {pow(1_000_003, 3, 536870909)}
        + coalesce(lead(c, 1) OVER o, 0) * {pow(1_000_003, 2, 536870909)} + coalesce(lead(c, 2) OVER o, 0) * 1000003
        + coalesce(lead(c, 3) OVER o, 0)) % 536870909 AS h FROM w JOIN c USING (w) WINDOW o AS (PARTITION BY r, kind ORDER BY i)),
m AS (SELECT r, kind, i, n, min({{'h': h, 'p': -i}}) OVER (PARTITION BY r, kind ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS m
      FROM g WHERE i <= greatest(1, n - 3)),
k AS (SELECT DISTINCT r, kind, m.h AS h, -m.p AS p FROM m WHERE i <= greatest(1, n - 6)),
p AS (SELECT r, kind, string_agg(hex(h), ',' ORDER BY p) AS s, list(DISTINCT h) AS hs FROM k GROUP BY r, kind),
f AS (SELECT e.*, coalesce(a.s, '') AS fa, coalesce(b.s, '') AS fb, coalesce(a.hs, []) AS ha, coalesce(b.hs, []) AS hb
      FROM e LEFT JOIN p a ON a.r = e.r AND a.kind = 0 LEFT JOIN p b ON b.r = e.r AND b.kind = 1),
z AS (SELECT *, coalesce(lead(ha) OVER (ORDER BY r), first_value(ha) OVER (ORDER BY r)) AS hn FROM f),
l AS (SELECT *, len(list_intersect(ha, hb)) AS cb, len(list_intersect(ha, hn)) AS cn FROM z)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(ed) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
  CASE WHEN len(ha) + len(hb) = 0 THEN 1.0::DOUBLE ELSE cb::DOUBLE / (len(ha) + len(hb) - cb) END AS near_edited,
  CASE WHEN len(ha) + len(hn) = 0 THEN 1.0::DOUBLE ELSE cn::DOUBLE / (len(ha) + len(hn) - cn) END AS near_next
FROM l
"""

# One round of the recursion a turn: of all edits into each of
# the four states (the last role initial, empty at the start), the cheapest with the least edit string stays.
SQL["op13_turn_repair"] = rf"""
WITH RECURSIVE {_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS chars FROM conversations),
g AS (SELECT conv_id, turn, role, text, {_CRC.format(bytes="list_transform(chars, lambda c: ascii(c)::BIGINT)")} % 20 AS place FROM k, tab),
r0 AS (SELECT conv_id, turn, CASE WHEN place = 4 THEN 'user' ELSE role END AS role,
        CASE place WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN place = 3 THEN 2 ELSE 1 END)) AS again FROM g WHERE place <> 0),
c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS v FROM (SELECT DISTINCT conv_id FROM conversations)),
r1 AS (SELECT v, turn, role, text, again, row_number() OVER (PARTITION BY v ORDER BY turn NULLS FIRST, role, text, again) AS i
       FROM r0 JOIN c ON r0.conv_id IS NOT DISTINCT FROM c.conv_id),
r2 AS (SELECT *, role[1:1] AS x, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS bl,
         row_number() OVER (PARTITION BY v, role, text ORDER BY i) > 1 AS dp,
         regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z') AS tr, lag(role[1:1]) OVER (PARTITION BY v ORDER BY i) AS bef FROM r1),
r AS (SELECT *, bl OR dp AS goes, (NOT bl AND NOT dp AND tr)::INT AS cut FROM r2),
f AS (SELECT v, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (bl) AS blank,
        count(*) FILTER (NOT bl AND dp) AS duplicate, sum(cut) AS truncated,
        count(*) FILTER (bef IS NOT NULL AND bef || x NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY v),
mv AS (SELECT q, ins, pos, CASE WHEN pos = 'u' THEN 'a' ELSE 'u' END AS nx FROM (VALUES ('', 0, ''), ('', 1, 'u'), ('', 2, 'a'),
         ('s', 0, 's'), ('s', 1, 'u'), ('s', 2, 'a'), ('u', 0, 'u'), ('u', 1, 'a'), ('a', 0, 'a'), ('a', 1, 'u')) AS st(q, ins, pos)),
tx AS (SELECT q, ins, pos, nx, CASE WHEN ins = 0 THEN [] WHEN ins = 2 THEN ['user:', 'assistant:'] WHEN pos = 'u' THEN ['user:'] ELSE ['assistant:'] END AS said FROM mv),
dp AS (
  SELECT v, 0::BIGINT AS i, '' AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS said FROM f
  UNION ALL
  SELECT v, i, z.q, z.cost, z.audit, z.said FROM (
      SELECT dp.v, r.i, min({{'cost': dp.cost + 2 * tx.ins + e.cost, 'audit': dp.audit || repeat('I', tx.ins) || e.op, 'q': e.q2,
               'said': list_concat(dp.said, tx.said, e.said)}}) AS z
      FROM dp JOIN r ON r.v = dp.v AND r.i = dp.i + 1 JOIN tx ON tx.q = dp.q,
        LATERAL (SELECT * FROM (VALUES ('D', 3, tx.pos, []::VARCHAR[], TRUE), ('R', 2 + r.cut, tx.nx, [CASE tx.nx WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text], NOT r.goes),
          ('K', r.cut, r.x, [r.role || ':' || r.text], NOT r.goes AND (tx.pos || r.x) IN ('s', 'u', 'su', 'ua', 'au')))
          AS e(op, cost, q2, said, ok) WHERE ok) e
      GROUP BY dp.v, r.i, e.q2)),
fin AS (SELECT v, min({{'cost': cost + 2 * ins, 'audit': audit || repeat('I', ins), 'said': list_concat(dp.said, tx.said)}}) AS z
        FROM dp JOIN f USING (v) JOIN tx USING (q) WHERE dp.i = f.n AND pos IN ('', 'a') GROUP BY v)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(z.cost, 0)::BIGINT AS cost,
  coalesce(z.audit, '') AS audit, sha256(coalesce(array_to_string(z.said, chr(10)), '')) AS repaired_sha256
FROM c LEFT JOIN f USING (v) LEFT JOIN fin USING (v)
"""
