"""The queries that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

WORD = r"'[^\x20\x09-\x0D]+'"
SPACE = r"'[\x20\x09-\x0D]'"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Shingle sets of all documents, pairs that share one, and all that links lead to.
MINHASH_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({LOWERED}, ''), {WORD}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' '))) AS sh FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 85 * (x.n + y.n - met)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low.low, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(low.low, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""

_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '###', '\h'), '</turn>', '\e')"

FORMAT_CHATS = rf"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
h AS (SELECT *, CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
    ELSE '=' || replace(replace({_ESCAPED.format("role")}, ':', '\c'), chr(10), '\n') END AS name FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('### ' || name || ': ') + length({_ESCAPED.format("text")}) + length('</turn>') + 1) AS formatted_chars FROM h GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g
"""

WARC_ARCHIVE = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, url, strlen(body) AS payload_bytes, upper(sha1(body)) AS hex FROM p),
e AS (SELECT page_id, url, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(hex, (1 + 10 * (k // 8))::BIGINT, 10))::BIGINT >> (5 * (7 - k % 8))::BIGINT) & 31))::BIGINT, 1)), '') AS payload_digest FROM d),
l AS (SELECT payload_digest, payload_bytes, max(page_id) AS last FROM e GROUP BY ALL),
k AS (SELECT *, regexp_extract(url, '^[^:/?#]+://([^/?#]*)([^#]*)', 1) AS host, regexp_extract(url, '^[^:/?#]+://([^/?#]*)([^#]*)', 2) AS rest, regexp_matches(url, '^[^:/?#]+://') AS full_url FROM e)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to,
    CASE WHEN full_url THEN array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END ELSE lower(coalesce(url, '')) END AS url_key,
    strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id % 86400), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM k JOIN l USING (payload_digest, payload_bytes)
"""

MIX_SOURCES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {WORD})), 0)::BIGINT AS size, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src FROM documents),
s AS (SELECT src, source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY src, source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER u AS n, coalesce(sum(cap) OVER b, 0::DOUBLE) AS over, coalesce(sum(w) OVER b, 0::DOUBLE) AS gone, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(w) OVER () AS ws
    FROM c WINDOW u AS (ORDER BY cap / w, src), b AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, greatest(0::DOUBLE, total - over) / (ws - gone) AS level FROM o),
t AS (SELECT src, source_size, least(cap, coalesce((SELECT min_by(level, n) FROM v WHERE level * w <= cap) * w, cap)) AS target FROM v),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('1|' || src), 1, 5))::BIGINT / 1048576::DOUBLE AS u,
    row_number() OVER (PARTITION BY src ORDER BY floor(log2(size + 1.5::DOUBLE) * 16), ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || size), 1, 4))::BIGINT % 64, doc_id NULLS FIRST, size) AS rank
    FROM d JOIN t USING (src)),
k AS (SELECT *, least(floor(rate * rank + u) - floor(rate * (rank - 1) + u), ceil(rate))::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, source FROM k
"""

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, {WORD}) AS ws, list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, {SPACE}, '', 'g')) > 0) AS lines FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
often AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM often, range(5) AS x(j) GROUP BY r),
m AS (SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, {SPACE}, '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations
    FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_upper > n_letters AND n_upper > 20 THEN 32 ELSE 0 END + CASE WHEN 5 * n_exclamations > n_words AND n_exclamations > 5 THEN 64 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
"""

#: A crc32 of the UTF-8 text x, by the table that the polynomial gives; `{x}` is any text expression.
_CRC_TABLE = "crc_table AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(k)))"
_BYTES = "list_transform(range(0, strlen({x})), lambda i: ('0x' || substr(hex({x}), (2 * i + 1)::BIGINT, 2))::BIGINT)"
_CRC = "xor(list_reduce(list_prepend(4294967295, " + _BYTES + "), lambda c, b: xor(c >> 8, t[(1 + (xor(c, b) & 255))::BIGINT])), 4294967295)"

IMPORTANCE_RESAMPLING = rf"""
WITH {_CRC_TABLE},
texts AS (SELECT row_number() OVER () AS r, doc_id, {LOWERED} AS text, 0 AS target FROM documents UNION ALL SELECT -row_number() OVER (), NULL, {LOWERED}, 1 FROM benchmark),
w AS (SELECT r, doc_id, target, coalesce(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM texts),
f AS (SELECT r, target, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS x FROM w),
c AS (SELECT r, target, x, count(*) AS n FROM f GROUP BY ALL),
k AS (SELECT x, {_CRC.format(x="x")} % 10000 AS bucket FROM (SELECT DISTINCT x FROM c), crc_table),
n AS (SELECT bucket, coalesce(sum(n) FILTER (target = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (target = 1), 0)::BIGINT AS t FROM c JOIN k USING (x) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n)::BIGINT + 10000)::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM n)::BIGINT + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
d AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM c JOIN k USING (x) JOIN g USING (bucket) GROUP BY r),
s AS (SELECT w.r, doc_id, len(ws) >= 20 AS eligible, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM w LEFT JOIN d USING (r) WHERE target = 0),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, r) AS place, count(*) OVER () * 25 // 100 AS wanted FROM s WHERE eligible)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END::BIGINT AS rank FROM s LEFT JOIN o USING (r)
"""

SPELLING_VARIANTS = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS x FROM documents),
c AS (SELECT doc_id, x, count(*) AS n FROM runs GROUP BY ALL),
h AS (SELECT x, n, {_CRC.format(x="y")} AS h FROM (SELECT x, n, coalesce(doc_id::VARCHAR, '') || ':' || x AS y FROM c), crc_table),
m AS (SELECT CASE WHEN h % 97 = 0 THEN substr(x, 1, (h % length(x))::BIGINT) || substr(x, (h % length(x) + 2)::BIGINT) ELSE x END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, n, i, substr(word, 1, i::BIGINT) || substr(word, (i + 2)::BIGINT) AS d FROM v, range(0, length(word)) AS r(i)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
    UNION SELECT v.word, x.word, x.n FROM v JOIN x ON x.d = v.word UNION SELECT x.word, v.word, v.n FROM v JOIN x ON x.d = v.word),
b AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
t AS (SELECT b.word, b.n_near, b.m, min(near.other) AS other FROM b JOIN near ON near.word = b.word AND near.m = b.m GROUP BY ALL),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END::BIGINT AS form_n FROM v LEFT JOIN t USING (word)),
up AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.next)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN up ON up.word = f.word AND up.next IS NULL
"""

#: The five primes of XXH64.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _xxh64(texts: str, seed: int) -> str:
    """CTEs from texts(sh) to hashed(sh, h), the XXH64 of each text's UTF-8, unsigned; numbers of 128 bits keep products whole."""
    p1, p2, p3, p4, p5 = _PRIMES
    all_ = 1 << 64
    times = lambda x, p: f"({x}) * {p}::UHUGEINT % {all_}::UHUGEINT"
    plus = lambda x, p: f"(({x}) + {p}::UHUGEINT) % {all_}::UHUGEINT"
    turned = lambda x, r: f"(({x}) * {1 << r}::UHUGEINT % {all_}::UHUGEINT + ({x}) // {1 << (64 - r)}::UHUGEINT)"
    xor = lambda x, y: f"xor(({x})::UBIGINT, ({y})::UBIGINT)::UHUGEINT"
    step = lambda x, y: times(turned(f"(({x}) + ({y}) * {p2}::UHUGEINT % {all_}::UHUGEINT) % {all_}::UHUGEINT", 31), p1)
    number = lambda at, n: "('0x' || " + " || ".join(f"substr(x, (2 * ({at}) + {2 * k + 1})::BIGINT, 2)" for k in reversed(range(n))) + ")::UHUGEINT"
    fold = lambda start, items, body: f"list_reduce(list_prepend({start}, {items}), lambda a, b: {body})"
    each = lambda a, b, at, n: f"list_transform(range({a}, {b}), lambda j: {number(at, n)})"
    first = ((seed + p1 + p2) % all_, (seed + p2) % all_, seed, (seed - p1) % all_)
    lanes = ", ".join(f"{fold(f'{v}::UHUGEINT', each(0, 'n // 32', f'32 * j + {8 * k}', 8), step('a', 'b'))} AS v{k}" for k, v in enumerate(first))
    merged = fold("(" + " + ".join(turned(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18))) + f") % {all_}::UHUGEINT", "[v0, v1, v2, v3]", plus(times(xor("a", step("0::UHUGEINT", "b")), p1), p4))
    eights = fold(f"(a + n::UHUGEINT) % {all_}::UHUGEINT", each(0, "n % 32 // 8", "n // 32 * 32 + 8 * j", 8), plus(times(turned(xor("a", step("0::UHUGEINT", "b")), 27), p1), p4))
    four = plus(times(turned(xor("a", times(number("n // 8 * 8", 4), p1)), 23), p2), p3)
    ones = fold("a", each("n // 4 * 4", "n", "j", 1), times(turned(xor("a", times("b", p5)), 11), p1))
    return f"""x0 AS (SELECT sh, lower(hex(sh)) AS x, strlen(sh) AS n FROM {texts}),
x1 AS (SELECT *, {lanes} FROM x0),
x2 AS (SELECT sh, x, n, CASE WHEN n < 32 THEN {seed + p5}::UHUGEINT ELSE {merged} END AS a FROM x1),
x3 AS (SELECT sh, x, n, {eights} AS a FROM x2),
x4 AS (SELECT sh, x, n, CASE WHEN n % 8 < 4 THEN a ELSE {four} END AS a FROM x3),
x5 AS (SELECT sh, {ones} AS a FROM x4),
x6 AS (SELECT sh, {times(xor("a", f"a // {1 << 33}::UHUGEINT"), p2)} AS a FROM x5),
x7 AS (SELECT sh, {times(xor("a", f"a // {1 << 29}::UHUGEINT"), p3)} AS a FROM x6),
hashed AS (SELECT sh, {xor("a", f"a // {1 << 32}::UHUGEINT")}::UBIGINT AS h FROM x7)"""


#: All pairs of distinct fingerprints.
SIMHASH_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({LOWERED}, ''), {WORD}) AS ws FROM documents),
g AS (SELECT r, unnest(list_transform(range(1, greatest(len(ws) - 1, 2)), lambda i: array_to_string(ws[i:i + 2], ' '))) AS sh FROM w WHERE len(ws) > 0),
texts AS (SELECT DISTINCT sh FROM g),
{_xxh64("texts", 42)},
p AS (SELECT r, {" + ".join(f"CASE WHEN 2 * sum((h >> {k}) & 1) > count(*) THEN {1 << k}::UBIGINT ELSE 0 END" for k in range(64))} AS fp FROM g JOIN hashed USING (sh) GROUP BY r),
f AS (SELECT doc_id, coalesce(fp, 0)::UBIGINT AS fp FROM w LEFT JOIN p USING (r)),
n AS (SELECT fp, min(doc_id) AS low FROM f GROUP BY fp),
links AS (SELECT a.fp AS a, b.fp AS b, b.low FROM n a JOIN n b ON bit_count(xor(a.fp, b.fp)::BIT) <= 3),
reach AS (SELECT a, b, low FROM links UNION SELECT r.a, l.b, l.low FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS fp, min(low) AS component_id FROM reach GROUP BY a)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM f JOIN c USING (fp)
"""

ORACLES = {
    "op1_minhash_dedup": MINHASH_DEDUP,
    "op5_format_chats": FORMAT_CHATS,
    "op6_warc_archive": WARC_ARCHIVE,
    "op9_mix_sources": MIX_SOURCES,
    "op10_quality_rules": QUALITY_RULES,
    "op11_simhash_dedup": SIMHASH_DEDUP,
    "op12_importance_resampling": IMPORTANCE_RESAMPLING,
    "op13_spelling_variants": SPELLING_VARIANTS,
}
