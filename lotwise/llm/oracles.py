"""The DuckDB SQL of those operators' queries that SQL can express."""

from __future__ import annotations

from lotwise.llm import block_anchors, quality_rules, topk, turn_repair, url_filter

_SPACE = r"\x20\x09-\x0D"

OP1 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS top FROM p), r AS (SELECT *, n >= 1000 AND page_id <> top AS again FROM d)
SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to FROM r"""

_RULES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in url_filter.RULES)
OP4 = f"""WITH rules(action, rhost, rpath) AS (VALUES {_RULES}), u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT h.page_id, h.host, h.path, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY h.page_id ORDER BY length(rhost || rpath) DESC, action) AS k FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.action, 'allow') AS verdict FROM h LEFT JOIN f ON f.page_id = h.page_id AND f.k = 1"""

OP5 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents), w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS s FROM d, unnest(range(0, n - 199)) AS x(i)),
r AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1), c AS (SELECT doc_id, i FROM w SEMI JOIN r USING (s)), g AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS cut FROM c),
k AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g), s AS (SELECT doc_id, span, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY doc_id, span), p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was FROM s),
o AS (SELECT p.doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) AS front, max(b) AS tail FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)"""


def _op8() -> str:
    count = lambda pattern: f"CAST(len(regexp_extract_all(t, '{pattern}')) AS BIGINT)"
    measures = quality_rules.MEASURES
    share = {m: f"CASE WHEN {of} > 0 THEN {n} / CAST({of} AS DOUBLE) ELSE 0 END" for m, (n, of, _, _) in measures.items()}
    seen = {m: f"NOT base_failed AND {n} > 0" if some else "NOT base_failed" for m, (n, _, _, some) in measures.items()}

    def level(name: str, on: str) -> str:
        own = ", ".join(f"list({m} ORDER BY {m}) FILTER ({seen[m]}) AS {m}_l" for m in measures)
        cut = ", ".join(f"coalesce(len({m}_l), 0) AS {m}_{name}_n, " + ", ".join(f"{m}_l[CAST(ceil({q} * len({m}_l)) AS INTEGER)] AS {m}_{name}_{i}" for i, q in enumerate(quality_rules.QUARTILES)) for m in measures)
        keys = f"{on}, " if on else ""
        return f"{name}_a AS (SELECT {keys}{own} FROM v {'GROUP BY ' + on if on else ''}), {name}_q AS (SELECT {keys}{cut} FROM {name}_a)"

    def mixed(m: str, i: int) -> str:
        q = f"{m}_all_{i}"
        for name in ("lang", "grp"):
            n = f"{m}_{name}_n"
            q = f"(CASE WHEN {n} > 0 THEN ({n} * {m}_{name}_{i} + {quality_rules.PRIOR_DOCS} * {q}) / ({n} + {quality_rules.PRIOR_DOCS}) ELSE {q} END)"
        return q

    mids = ", ".join(f"{mixed(m, i)} AS {m}_{i}" for m in measures for i in range(3))
    fence, lift = quality_rules.FENCE, quality_rules.LIFT
    high = lambda m: f"{m} <= {m}_1 + {fence} * least({m}_2 - {m}_1, {lift} * ({m}_1 - {m}_0))"
    low = lambda m: f"{m} >= {m}_1 - {fence} * least({m}_1 - {m}_0, {lift} * ({m}_2 - {m}_1))"
    tests = [f"({n} = 0 OR coalesce({high(m)}, true))" if some else f"coalesce({high(m)}, true)" for m, (n, _, _, some) in measures.items()] + [f"coalesce({low(m)}, true)" for m in measures if measures[m][2]]
    return f"""WITH x AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents), y AS (SELECT *, regexp_extract_all(t, '[^{_SPACE}]+') AS w, [z FOR z IN string_split(t, chr(10)) IF regexp_matches(z, '[^{_SPACE}]')] AS lines FROM x),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS five FROM y, unnest(range(1, len(w) - 3)) AS q(i)), twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, unnest(range(0, 5)) AS q(j) GROUP BY doc_id),
c AS (SELECT y.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[{_SPACE}]', '', 'g')) AS BIGINT) AS word_chars, {count("[#*$%&|<>]")} AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines, {count("[!-/:-@\\[-`{-~]")} AS n_signs FROM y LEFT JOIN rep ON rep.doc_id = y.doc_id),
v AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed, {", ".join(f"{s} AS {m}" for m, s in share.items())} FROM c),
{level("grp", "lang, source")}, {level("lang", "lang")}, {level("all", "")}, q AS (SELECT lang, source, {mids} FROM grp_q JOIN lang_q USING (lang), all_q)
SELECT doc_id, {", ".join(quality_rules.COUNTS[:5])}, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept FROM v JOIN q USING (lang, source)"""


OP8 = _op8()
OP9 = f"""WITH v AS (SELECT vec_id, [floor({topk.SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % {topk.EVERY} = 0 AND c.vec_id <> q.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {topk.K}"""


def _op11() -> str:
    # CRC-32 by its reflected polynomial, bit by bit
    crc = "list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(k, '')]), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))))"
    states = turn_repair.STATES
    more = lambda x, cost, letter: f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}'}} END"
    gone = {s: more(f"f.{s}", turn_repair.DELETE, "D") for s in states}

    def left(x: str, initial: str) -> str:
        return f"CASE WHEN must THEN NULL WHEN initial = '{initial}' THEN {more(x, f'extra + {turn_repair.KEEP}', 'K')} ELSE {more(x, f'extra + {turn_repair.REROLE}', 'R')} END"

    system = f"CASE WHEN NOT must AND initial = 's' THEN {more('f.e', f'extra + {turn_repair.KEEP}', 'K')} END"
    none = "NULL::STRUCT(c BIGINT, a VARCHAR)"
    add = lambda x: more(x, turn_repair.INSERT, "I")
    step = f"""SELECT f.conv_id, f.n + 1 AS n, {gone["e"]} AS e, least({gone["s"]}, {system}) AS s, least({gone["u"]}, {left("least(f.e, f.s, f.a)", "u")}) AS u, least({gone["a"]}, {left("f.u", "a")}) AS a FROM f JOIN t ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND t.n = f.n + 1"""
    return f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
d AS (SELECT *, xor({crc}, 4294967295) % 20 AS fate FROM c),
x AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, substr(role, 1, 1) AS initial, regexp_replace(text, '[{_SPACE}]+$', '') AS body FROM x),
p AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM o),
t AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS must, CASE WHEN fault = 'truncated' THEN {turn_repair.TRUNCATED} ELSE 0 END AS extra FROM p),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS turns FROM t GROUP BY conv_id),
f AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, {{'c': 0::BIGINT, 'a': ''}} AS e, {none} AS s, {{'c': {turn_repair.INSERT}::BIGINT, 'a': 'I'}} AS u, {{'c': {2 * turn_repair.INSERT}::BIGINT, 'a': 'II'}} AS a FROM (SELECT DISTINCT conv_id FROM c)
UNION ALL SELECT conv_id, n, e, s, u2 AS u, least(a, {add("u2")}) AS a FROM (SELECT *, least(u, {add("e")}, {add("s")}, {add("a")}) AS u2 FROM ({step}))),
b AS (SELECT f.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, least(e, a).c AS cost, least(e, a).a AS audit FROM f LEFT JOIN g ON f.conv_id IS NOT DISTINCT FROM g.conv_id WHERE f.n = coalesce(g.turns, 0)),
l AS (SELECT conv_id, j, substr(audit, j, 1) AS letter, length(replace(substr(audit, 1, j), 'I', '')) AS row, (length(replace(substr(audit, 1, j), 'D', '')) + length(replace(audit, 'D', ''))) % 2 = 1 AS user FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM b)),
r AS (SELECT l.conv_id, string_agg(CASE letter WHEN 'K' THEN role ELSE CASE WHEN user THEN 'user' ELSE 'assistant' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS repaired FROM l LEFT JOIN t ON l.conv_id IS NOT DISTINCT FROM t.conv_id AND t.n = l.row WHERE letter <> 'D' GROUP BY l.conv_id)
SELECT b.*, sha256(coalesce(repaired, '')) AS repaired_sha256 FROM b LEFT JOIN r ON b.conv_id IS NOT DISTINCT FROM r.conv_id"""


OP11 = _op11()
_W = block_anchors.WINDOW
OP12 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w FROM documents), x AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + {_W - 1}], ' ')) AS s FROM d, unnest(range(1, len(w) - {_W - 2})) AS q(i)),
c AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY s) > 1), g AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {_W} THEN 0 ELSE 1 END AS cut FROM c),
k AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g), s AS (SELECT doc_id, span, min(i) AS a, max(i) + {_W} AS b FROM k GROUP BY doc_id, span), p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS was FROM s),
o AS (SELECT p.doc_id, sum(b - a) AS gone, count(*) AS spans, flatten(list(w[was:a - 1] ORDER BY a)) AS front, max(b) AS tail FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(array_to_string(list_concat(coalesce(front, []), w[coalesce(tail, 1):]), ' ')) AS kept_sha256, coalesce(spans, 0) AS n_spans FROM d LEFT JOIN o USING (doc_id)"""
