"""DuckDB SQL for the queries that it can express, by brute force: every string, every pair of sets, every character."""

from __future__ import annotations

import string

from tillroll.llm.op03_url_filter import ALPHABET, ORDER, RULES

_LOW = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"

#: every 400-byte string of every text, compared by its digest
OP1 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT rid, s, md5(substr(h, CAST(2 * s + 1 AS BIGINT), 800)) AS k FROM (SELECT rid, h, unnest(range(0, greatest(n - 399, 0))) AS s FROM d)),
twice AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
dup AS (SELECT rid, s, CASE WHEN s <= lag(s) OVER (PARTITION BY rid ORDER BY s) + 400 THEN 0 ELSE 1 END AS fresh FROM p WHERE k IN (SELECT k FROM twice)),
runs AS (SELECT rid, s, sum(fresh) OVER (PARTITION BY rid ORDER BY s) AS run FROM dup),
spans AS (SELECT rid, min(s) AS lo, max(s) + 400 AS hi FROM runs GROUP BY rid, run),
gaps AS (SELECT rid, lo, lag(hi, 1, 0) OVER (PARTITION BY rid ORDER BY lo) AS prev, hi FROM spans),
cut AS (SELECT g.rid, count(*) AS n_spans, CAST(sum(hi - lo) AS BIGINT) AS n_removed, max(hi) AS last,
               string_agg(substr(h, CAST(2 * prev + 1 AS BIGINT), CAST(2 * (lo - prev) AS BIGINT)), '' ORDER BY lo) AS kept
        FROM gaps g JOIN d USING (rid) GROUP BY g.rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE kept || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (rid)
"""

#: every pair of sets that share a shingle, and every document reachable from every other
OP5 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT rid, doc_id, list_distinct(CASE
        WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
e AS MATERIALIZED (SELECT rid, len(sh) AS n, unnest(sh) AS x FROM s),
link AS MATERIALIZED (SELECT a.rid AS u, b.rid AS v FROM e a JOIN e b ON a.x = b.x AND a.rid <> b.rid
        GROUP BY a.rid, b.rid HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT rid AS u, rid AS v FROM s UNION SELECT r.u, l.v FROM reach r JOIN link l ON l.u = r.v)
SELECT s.doc_id, len(s.sh) AS n_shingles, CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE c.low END AS component_id
FROM s JOIN (SELECT u, min(t.doc_id) AS low FROM reach JOIN s t ON t.rid = reach.v GROUP BY u) c ON c.u = s.rid
"""

#: every phrase of every piece, counted as a list of words
OP13 = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_LOW}) AS t FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1),
g AS ({" UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: w[i:i + {k - 1}])) AS words FROM p WHERE len(w) >= {k}" for k in (1, 2, 3, 4))}),
f AS MATERIALIZED (SELECT lang, words, count(*) AS f FROM g GROUP BY 1, 2 HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, words, f AS a FROM f WHERE len(words) >= 2),
cut AS (SELECT lang, words, a, k, words[:k] AS head, words[k + 1:] AS tail FROM (SELECT *, unnest(range(1, len(words))) AS k FROM c)),
scored AS (SELECT cut.*, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f::HUGEINT + y.f) AS BIGINT) AS score
           FROM cut JOIN f x ON x.lang = cut.lang AND x.words = head JOIN f y ON y.lang = cut.lang AND y.words = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
part AS (SELECT lang, a, unnest(list_transform(range(1, len(words) - size + 2), lambda i: words[i:i + size - 1])) AS words
         FROM (SELECT *, unnest(range(2, len(words))) AS size FROM c)),
around AS (SELECT lang, words, max(a) AS most FROM part GROUP BY 1, 2),
kept AS (SELECT b.*, array_to_string(b.words, ' ') AS phrase FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.words = b.words
         WHERE o.most IS NULL OR 100::HUGEINT * o.most < 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000
"""


def _op3(rules, order: int = 3, alphabet: int = 40) -> str:
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))]
    rule = " ".join(f"WHEN {f} THEN '{n}'" for f, n, _ in fits)
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits)
    spare = "substr(md5(spelled), 1, 1) IN ('0', '1', '2', '3')"
    levels, joins, chance = [], [], {c: f"(1.0::DOUBLE / {alphabet})" for c in ("allow", "block")}
    for k in range(order + 1):
        levels.append(f"""q{k} AS (SELECT substr(gram, {order - k + 1}, {k + 1}) AS seq, substr(gram, {order - k + 1}, {k}) AS ctx, sum(allow) AS allow_n, sum(block) AS block_n FROM g GROUP BY 1, 2),
c{k} AS (SELECT ctx, sum(allow_n) AS allow_all, sum(block_n) AS block_all, count(*) FILTER (WHERE allow_n > 0) AS allow_kinds, count(*) FILTER (WHERE block_n > 0) AS block_kinds FROM q{k} GROUP BY 1)""")
        joins.append(f"JOIN q{k} ON q{k}.seq = substr(g.gram, {order - k + 1}, {k + 1}) JOIN c{k} ON c{k}.ctx = q{k}.ctx")
        for c in chance:
            chance[c] = f"(CASE WHEN c{k}.{c}_all > 0 THEN (q{k}.{c}_n + c{k}.{c}_kinds * {chance[c]}) / (c{k}.{c}_all + c{k}.{c}_kinds) ELSE {chance[c]} END)"
    return f"""
WITH p AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_LOW}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
              regexp_replace(regexp_replace(translate(coalesce(url, ''), {_LOW}), '[0-9]', '0', 'g'), '[^a-z0./:?=&_#%\\-]', '~', 'g') AS spelled FROM p),
v AS MATERIALIZED (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS ruled FROM hp),
u AS (SELECT spelled, ruled, count(*) AS n FROM v GROUP BY 1, 2),
each AS (SELECT spelled, ruled, n, unnest(list_transform(range(1, length(spelled) + 2), lambda i: substr('{'^' * order}' || spelled || '$', i, {order + 1}))) AS gram FROM u WHERE spelled <> ''),
g AS MATERIALIZED (SELECT gram, sum(CASE WHEN ruled = 'allow' AND NOT {spare} THEN n ELSE 0 END) AS allow, sum(CASE WHEN ruled = 'block' AND NOT {spare} THEN n ELSE 0 END) AS block FROM each GROUP BY 1),
{", ".join(levels)},
w AS (SELECT g.gram, ln({chance["allow"]}) - ln({chance["block"]}) AS weight FROM g {" ".join(joins)}),
taught AS (SELECT coalesce(sum(allow), 0) > 0 AND coalesce(sum(block), 0) > 0 AS known FROM g),
s AS MATERIALIZED (SELECT x.spelled, CASE WHEN (SELECT known FROM taught) THEN coalesce(t.score, 0.0) ELSE 0.0 END AS score
      FROM (SELECT DISTINCT spelled FROM u) x LEFT JOIN (
        SELECT spelled, sum(weight) / count(*) AS score FROM (SELECT DISTINCT spelled, unnest(list_transform(range(1, length(spelled) + 2), lambda i: {{'i': i, 'gram': substr('{'^' * order}' || spelled || '$', i, {order + 1})}})) AS y FROM u WHERE spelled <> '') z
        JOIN w ON w.gram = z.y.gram GROUP BY 1) t USING (spelled)),
hist AS (SELECT least(greatest(round(score * 100), -2000), 2000) AS step, sum(CASE WHEN ruled = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN ruled = 'block' THEN n ELSE 0 END) AS b
         FROM u JOIN s USING (spelled) WHERE ruled IS NOT NULL AND {spare} GROUP BY 1),
rates AS (SELECT step, lag(step) OVER o AS last, sum(a) OVER () AS all_a, sum(b) OVER () AS all_b, coalesce(sum(a) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_a,
                 coalesce(sum(b) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_b FROM hist WINDOW o AS (ORDER BY step)),
best AS (SELECT coalesce(step - 0.5 + CASE WHEN last IS NULL THEN 0 ELSE (last - step) / 2 + 0.5 END, 0) / 100 AS edge FROM rates WHERE all_a > 0 AND all_b > 0
         ORDER BY round((all_a - below_a) / all_a + below_b / all_b, 12) DESC, step LIMIT 1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= coalesce((SELECT edge FROM best), 0) THEN 'allow' ELSE 'block' END) AS verdict FROM v JOIN s USING (spelled)
"""


def _op12(words: int = 4, seed: int = 42, near: int = 4) -> str:
    """XXH64 of every shingle by its definition, in 128-bit integers, and every pair of different fingerprints."""
    primes = [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5]
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in primes)
    whole, low = f"{1 << 64}::UHUGEINT", f"{0x0F0F0F0F0F0F0F0F}::UBIGINT"

    def turn(x, bits):
        return f"(({x}) * {1 << bits}::UHUGEINT // {whole} + ({x}) * {1 << bits}::UHUGEINT % {whole})"

    def mixed(x):
        return f"({turn(f'({x}) * {p2} % {whole}', 31)} * {p1} % {whole})"

    def number(start, digits):  # little-endian: the hex digits backwards, then the two of each byte swapped
        x = f"('0x' || reverse(substr(x, CAST({start} AS BIGINT), {digits})))::UBIGINT"
        return f"(((({x}) & {low}) << 4) | ((({x}) >> 4) & {low}))::UHUGEINT"

    def step(bits, times, plus):
        return f"lambda v, k: ({turn('xor(v, k)', bits)} * {times} + {plus}) % {whole}"

    first = [(seed + p) % (1 << 64) for p in (primes[0] + primes[1], primes[1], 0, -primes[0])]
    four = ", ".join(f"list_reduce(list_transform(range({j}, 4 * (n // 32), 4), lambda i: lanes[i + 1]), "
                     f"lambda v, k: {turn(f'(v + k * {p2} % {whole}) % {whole}', 31)} * {p1} % {whole}, {v}::UHUGEINT) AS v{j}" for j, v in enumerate(first))
    met = (f"list_reduce([{', '.join(mixed(f'v{j}') for j in range(4))}], lambda v, k: (xor(v, k) * {p1} + {p4}) % {whole}, "
           f"({' + '.join(turn(f'v{j}', bits) for j, bits in enumerate((1, 7, 12, 18)))}) % {whole})")
    votes = ", ".join(f"CAST(sum(e.copies * ((s.h >> {b}) & 1)) AS BIGINT) AS b{b}" for b in range(64))
    bits = " | ".join(f"(CASE WHEN 2 * b{b} > n THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END)" for b in range(64))
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
e AS MATERIALIZED (SELECT rid, shingle, count(*) AS copies FROM (SELECT rid, unnest(CASE
        WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d) GROUP BY 1, 2),
x AS (SELECT shingle, hex(encode(shingle)) AS x, octet_length(encode(shingle)) AS n FROM (SELECT DISTINCT shingle FROM e)),
x8 AS MATERIALIZED (SELECT *, list_transform(range(0, n // 8), lambda i: {number("16 * i + 1", 16)}) AS lanes FROM x),
x32 AS MATERIALIZED (SELECT *, {four} FROM x8),
h0 AS MATERIALIZED (SELECT *, (CASE WHEN n >= 32 THEN {met} ELSE {(seed + primes[4]) % (1 << 64)}::UHUGEINT END + n::UHUGEINT) % {whole} AS h0 FROM x32),
h1 AS MATERIALIZED (SELECT *, list_reduce(list_transform(range(4 * (n // 32), n // 8), lambda i: {mixed("lanes[i + 1]")}), {step(27, p1, p4)}, h0) AS h1 FROM h0),
h2 AS MATERIALIZED (SELECT *, list_reduce(list_transform(range(0, n % 8 // 4), lambda i: {number("16 * (n // 8) + 1", 8)} * {p1} % {whole}), {step(23, p2, p3)}, h1) AS h2 FROM h1),
h3 AS MATERIALIZED (SELECT *, list_reduce(list_transform(range(n - n % 4, n), lambda i: {number("2 * i + 1", 2)} * {p5} % {whole}), {step(11, p1, "0::UHUGEINT")}, h2) AS h3 FROM h2),
h4 AS MATERIALIZED (SELECT shingle, xor(h3, h3 // {1 << 33}::UHUGEINT) * {p2} % {whole} AS h4 FROM h3),
h5 AS MATERIALIZED (SELECT shingle, xor(h4, h4 // {1 << 29}::UHUGEINT) * {p3} % {whole} AS h5 FROM h4),
s AS MATERIALIZED (SELECT shingle, CAST(xor(h5, h5 // {1 << 32}::UHUGEINT) AS UBIGINT) AS h FROM h5),
votes AS MATERIALIZED (SELECT e.rid, CAST(sum(e.copies) AS BIGINT) AS n, {votes} FROM e JOIN s USING (shingle) GROUP BY e.rid),
f AS MATERIALIZED (SELECT d.doc_id, coalesce({bits}, 0::UBIGINT) AS fp FROM d LEFT JOIN votes USING (rid)),
node AS MATERIALIZED (SELECT fp, min(doc_id) AS low FROM f GROUP BY 1),
link AS MATERIALIZED (SELECT a.fp AS u, b.fp AS v FROM node a JOIN node b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= {near}),
reach AS (SELECT fp AS u, fp AS v FROM node UNION SELECT r.u, l.v FROM reach r JOIN link l ON l.u = r.v)
SELECT f.doc_id, lpad(lower(to_hex(f.fp)), 16, '0') AS fingerprint, c.low AS component_id
FROM f JOIN (SELECT u, min(node.low) AS low FROM reach JOIN node ON node.fp = reach.v GROUP BY u) c ON c.u = f.fp
"""


OP3 = _op3(RULES, ORDER, ALPHABET)
OP12 = _op12()
