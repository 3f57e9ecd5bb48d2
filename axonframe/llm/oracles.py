"""The queries' results as SQL, for those that SQL can express."""

from __future__ import annotations

from axonframe.llm.licenses import COVER, K, SHIFT, template_rows
from axonframe.llm.mixing import MOST, SLICE
from axonframe.llm.secret_scan import BASE, RULES

ARCHIVES = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
e AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(x, CAST(10 * (i // 8) + 1 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest FROM d),
m AS (SELECT *, MAX(page_id) OVER (PARTITION BY payload_digest) AS r FROM e)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = r THEN NULL ELSE r END AS refers_to FROM m
"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit: a step per character and eight per shift."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), {step}), CAST(4294967295 AS BIGINT))"


def _field(value: str) -> str:
    return f"COALESCE(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _fold(name: str, leaves: str) -> str:
    """All levels over ``leaves(g, pos, d)``: ``name(g, level, pos, d)``."""
    return f"""{name} AS (SELECT g, 0 AS level, pos, d, COUNT(*) OVER (PARTITION BY g) AS n FROM {leaves}
    UNION ALL SELECT g, level + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (ANY_VALUE(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, level, pos // 2)"""


def merkle() -> str:
    fields = "doc_id source lang n_chars text".split()
    changed = [f"CASE WHEN bad THEN {c} + 1 ELSE {c} END" if c == "n_chars" else c for c in fields]
    groups = "struct_pack(nul := lang IS NOT NULL, name := COALESCE(encode(lang), ''::BLOB))"
    return f"""
WITH RECURSIVE d AS (SELECT *, COALESCE({crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0, FALSE) AS bad FROM documents),
l AS MATERIALIZED (SELECT doc_id, {groups} AS g, sha256({" || ".join(map(_field, fields))}) AS leaf, sha256({" || ".join(map(_field, changed))}) AS changed FROM d),
r AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
la AS (SELECT g, pos, leaf AS d FROM r),
{_fold("t", "la")},
tm AS MATERIALIZED (SELECT g, level, pos, d FROM t),
s AS MATERIALIZED (SELECT g, MAX_BY(d, level) AS subroot, ROW_NUMBER() OVER (ORDER BY g) - 1 AS place FROM tm GROUP BY g),
sa AS (SELECT 0 AS g, place AS pos, subroot AS d FROM s),
{_fold("u", "sa")},
um AS MATERIALIZED (SELECT level, pos, d FROM u),
heights AS (SELECT g, MAX(level) AS h FROM tm GROUP BY g),
p AS (SELECT r.g, r.pos, x.lv, CAST(((r.pos >> x.lv) & 1) AS INT) AS odd, COALESCE(o.d, '') AS other FROM r JOIN heights USING (g)
    CROSS JOIN LATERAL (SELECT UNNEST(range(0, h)) AS lv) x LEFT JOIN tm o ON o.g = r.g AND o.level = x.lv AND o.pos = xor(r.pos >> x.lv, 1)),
pa AS (SELECT g, pos, list(struct_pack(a := CASE WHEN odd = 1 THEN other ELSE '' END, b := CASE WHEN odd = 1 THEN '' ELSE other END) ORDER BY lv) AS steps FROM p GROUP BY g, pos),
q AS (SELECT s.g, x.lv, CAST(((place >> x.lv) & 1) AS INT) AS odd, COALESCE(o.d, '') AS other FROM s
    CROSS JOIN LATERAL (SELECT UNNEST(range(0, (SELECT MAX(level) FROM um))) AS lv) x LEFT JOIN um o ON o.level = x.lv AND o.pos = xor(place >> x.lv, 1)),
qa AS (SELECT g, list(struct_pack(a := CASE WHEN odd = 1 THEN other ELSE '' END, b := CASE WHEN odd = 1 THEN '' ELSE other END) ORDER BY lv) AS steps FROM q GROUP BY g),
f AS (SELECT r.doc_id, r.leaf, s.subroot, (SELECT MAX_BY(d, level) FROM um) AS root, changed, list_concat(COALESCE(pa.steps, []), COALESCE(qa.steps, [])) AS steps
    FROM r JOIN s USING (g) LEFT JOIN pa ON pa.g = r.g AND pa.pos = r.pos LEFT JOIN qa ON qa.g = r.g),
z AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x.a || x.b), '')) AS proof_sha256,
    list_reduce(list_prepend(struct_pack(a := changed, b := ''), steps), lambda x, y: struct_pack(a := sha256(y.a || x.a || y.b), b := '')).a AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM z
"""


TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v, ROW_NUMBER() OVER () AS r FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, a.r, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
k AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10
"""


def prefix_trie() -> str:
    return rf"""
WITH t AS (SELECT conv_id, turn, octet_length(encode(COALESCE(role, ''))) || ':' || COALESCE(role, '') || COALESCE(text, '') AS s,
    len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(s ORDER BY turn NULLS FIRST, md5(s)) AS s, list(words ORDER BY turn NULLS FIRST, md5(s)) AS w, CAST({crc32("CAST(conv_id AS VARCHAR)")} % 4 AS INT) AS h FROM t GROUP BY conv_id),
b AS (SELECT o.conv_id, list_concat(COALESCE(a.s[1 : o.h], []), o.s[o.h + 1 :]) AS s, list_concat(COALESCE(a.w[1 : o.h], []), o.w[o.h + 1 :]) AS w
    FROM o LEFT JOIN o a ON a.conv_id = o.conv_id - o.conv_id % 20),
e AS (SELECT *, UNNEST(range(0, len(s) + 1)) AS depth FROM b),
n AS MATERIALIZED (SELECT s[1 : depth] AS k, depth, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, COALESCE(ANY_VALUE(w[depth]), 0) AS words,
    sha256(COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = len(s)), '')) AS ends_sha256 FROM e GROUP BY 1, 2),
c AS (SELECT p.conv_id, p.depth, COUNT(*) AS n_children FROM n JOIN n p ON p.depth = n.depth - 1 AND p.k = n.k[1 : n.depth - 1] GROUP BY 1, 2),
m AS (SELECT n.*, COALESCE(n_children, 0) AS n_children FROM n LEFT JOIN c USING (conv_id, depth)),
u AS (SELECT *, UNNEST(range(0, depth + 1)) AS up FROM m),
x AS (SELECT k[1 : up] AS k, up AS depth, COUNT(*) FILTER (n_children = 0) AS n_leaves, CAST(SUM((n_convs - 1) * words) AS BIGINT) AS saved_tokens FROM u GROUP BY 1, 2)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN x ON x.depth = m.depth AND x.k = m.k LEFT JOIN n p ON p.depth = m.depth - 1 AND p.k = m.k[1 : m.depth - 1]
"""


def secrets() -> str:
    parts = []
    for rank, rule in enumerate(RULES):
        pattern = rule.plain.replace("'", "''")
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(t, '{pattern}', 0) AS hits,
            regexp_extract_all(t, '{pattern}', {rule.group}) AS measured, string_split_regex(t, '{pattern}') AS gaps FROM d""")
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    return f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(parts)}),
h AS (SELECT doc_id, rank, kind, least, hits, measured, gaps, UNNEST(range(1, len(hits) + 1)) AS i FROM s),
e AS (SELECT doc_id, rank, kind, len(hits[i]) AS n, len(measured[i]) >= least AS ok,
    CAST(list_sum(list_transform(hits[1:i], lambda x: len(x))) + list_sum(list_transform(gaps[1:i], lambda x: len(x))) AS BIGINT) AS stop FROM h),
f AS (SELECT doc_id, rank, kind, stop - n AS start, kind || ':' || (stop - n) || ':' || stop AS span FROM e WHERE ok),
g AS (SELECT doc_id, COUNT(*) FILTER (kind = 'assign') AS a, COUNT(*) FILTER (kind = 'access') AS c, COUNT(*) FILTER (kind = 'hex') AS x,
    string_agg(span, ',' ORDER BY start, rank) FILTER (kind IN ({base})) AS b, string_agg(span, ',' ORDER BY start, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, COALESCE(a, 0) AS n_assign, COALESCE(c, 0) AS n_access, COALESCE(x, 0) AS n_hex,
    sha256(COALESCE(b, '')) AS base_sha256, COALESCE(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


def components_of(words: int, percent: int) -> str:
    spaces = r"[^\x20\x09-\x0D]+"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{upper}', '{upper.lower()}'), '{spaces}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i : i + {words - 1}], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s), u AS MATERIALIZED (SELECT doc_id, UNNEST(g) AS g FROM s),
t AS MATERIALIZED (SELECT doc_id, g FROM u WHERE g IN (SELECT g FROM u GROUP BY g HAVING COUNT(*) > 1)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
h AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
l AS MATERIALIZED (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, MIN(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""


MIXTURE = f"""
WITH RECURSIVE d AS (SELECT *, COALESCE(source, '') AS s FROM documents),
c AS (SELECT s, CAST(SUM(length(COALESCE(text, ''))) AS BIGINT) AS chars FROM d GROUP BY s),
w AS (SELECT s, chars, CASE WHEN chars > 0 THEN 1e0 ELSE 0e0 END AS weight FROM c),
a AS (SELECT CAST(SUM(chars) AS BIGINT) AS all_chars, SUM(weight) AS all_weight FROM w),
r AS (SELECT s, CASE WHEN chars > 0 THEN weight / all_weight * all_chars * 1e0 / chars ELSE 0e0 END AS rate FROM w, a),
q AS (SELECT s, rate, CAST(GREATEST(1, CEIL(rate / {SLICE}e0)) AS BIGINT) AS slices, rate / GREATEST(1, CEIL(rate / {SLICE}e0)) AS part FROM r),
k AS (SELECT s, part, 0 AS k, EXP(-part) AS p, EXP(-part) AS cdf FROM q
    UNION ALL SELECT s, part, k + 1, p * part / (k + 1), cdf + p * part / (k + 1) FROM k WHERE k < {MOST - 1}),
i AS (SELECT d.*, rate, UNNEST(range(0, slices)) AS slice FROM d JOIN q USING (s)),
u AS (SELECT *, CAST('0x' || substr(md5('1:' || doc_id || CASE WHEN slice = 0 THEN '' ELSE ':' || slice END), 1, 12) AS BIGINT) / 281474976710656e0 AS u FROM i),
n AS (SELECT doc_id, slice, COUNT(*) AS n FROM u JOIN k USING (s) WHERE cdf <= u GROUP BY doc_id, slice),
e AS (SELECT u.doc_id, text, lang, source, n_chars, rate, slice * {MOST} + UNNEST(range(0, n)) AS copy FROM u JOIN n USING (doc_id, slice))
SELECT doc_id, text, lang, source, n_chars, copy, rate,
    CAST('0x' || substr(md5('1 order:' || doc_id || ':' || copy), 1, 12) AS BIGINT) / 281474976710656e0 AS shuffle_key FROM e
"""


def licenses() -> str:
    rows = ", ".join(f"('{t}', '{label}', {base}, {n}, {i}, '{gram}')" for t, label, base, n, i, gram in template_rows())
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH tpl(template, label, is_base, n_tpl, place, gram) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT doc_id, w, UNNEST(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i - 1 AS spot, array_to_string(w[i : i + 1], ' ') AS gram FROM i WHERE i < len(w)
    UNION ALL SELECT doc_id, i - 1, array_to_string(w[i : i + {K - 1}], ' ') FROM i WHERE i + {K - 1} <= len(w)),
v AS (SELECT doc_id, template, label, is_base, n_tpl, spot - place AS diagonal, COUNT(DISTINCT spot) AS votes, list(DISTINCT place) AS places, MIN(spot) AS first_at, MAX(spot) AS last_at
    FROM g JOIN tpl USING (gram) GROUP BY ALL),
b AS (SELECT doc_id, label, diagonal AS start, 1e0 AS cover, TRUE AS is_base FROM v WHERE is_base AND votes = n_tpl),
o AS (SELECT *, LAG(diagonal) OVER r AS before, LAG(last_at) OVER r AS ended FROM v WHERE NOT is_base WINDOW r AS (PARTITION BY doc_id, template ORDER BY first_at, diagonal)),
l AS (SELECT *, SUM(CASE WHEN before IS NULL OR ABS(diagonal - before) > {SHIFT} OR first_at - ended > {K + SHIFT} THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id, template ORDER BY first_at, diagonal) AS island FROM o),
p AS (SELECT doc_id, label, template, island, n_tpl, first_at, last_at, UNNEST(places) AS place FROM l),
q AS (SELECT *, UNNEST(range(place, place + {K})) AS word FROM p),
s AS (SELECT doc_id, label, template, island, MIN(first_at) AS start, COUNT(DISTINCT place) / CAST(n_tpl AS DOUBLE) AS cover,
    COUNT(DISTINCT word) >= {COVER} * (MAX(last_at) + {K} - MIN(first_at)) AS tight FROM q GROUP BY doc_id, label, template, island, n_tpl),
f AS (SELECT * FROM b UNION ALL SELECT doc_id, label, start, cover, FALSE FROM s WHERE cover >= {COVER} AND tight),
e AS (SELECT doc_id, COUNT(*) FILTER (is_base) AS n_base, MIN(start) FILTER (is_base) AS first_word, MAX(start) FILTER (is_base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, MAX(cover) AS score FROM f GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    COALESCE(base_labels, '') AS base_labels, COALESCE(labels, '') AS labels, COALESCE(score, 0e0) AS score FROM d LEFT JOIN e USING (doc_id)
"""
