"""DuckDB's SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import decontam, licenses, linededup, mixing, release, search, topk

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_scan(threshold: float = licenses.THRESHOLD) -> str:
    rows = ", ".join(f"({i}, {_quoted(name)}, {_quoted(body)})" for i, (name, body) in enumerate(licenses.TEMPLATES))
    words = "regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+')"
    grams = "CASE WHEN len(w) >= 2 THEN list_transform(list_zip(w[1 : len(w) - 1], w[2 : len(w)]), lambda p: p[1] || ' ' || p[2]) ELSE w END"
    low = threshold / (2 - threshold)
    return f"""WITH t AS (SELECT template, license, list_distinct({grams}) AS t, greatest(1, len(w) - 1) AS width FROM (SELECT template, license, {words} AS w FROM (VALUES {rows}) v(template, license, body))),
docs AS (SELECT doc_id, r, {grams} AS g FROM (SELECT doc_id, row_number() OVER () AS r, {words} AS w FROM (SELECT doc_id, text AS body FROM documents WHERE text IS NOT NULL)) WHERE len(w) > 0),
near AS (SELECT * FROM docs JOIN t ON len(g) >= {low!r}::DOUBLE * len(t) - 1e-9 AND len(list_intersect(g, t)) >= {threshold * (low + 1) / 2!r}::DOUBLE * len(t) - 1e-9),
wins AS (SELECT doc_id, r, template, license, width, t, p, list_distinct(g[p : p + width - 1]) AS s FROM (SELECT *, unnest(list_filter(range(1, len(g) + 1), lambda i: list_contains(t, g[i]))) AS p FROM near)),
met AS (SELECT doc_id, r, template, license, width, p, 2 * len(list_intersect(s, t)) / (len(s) + len(t)) AS dice FROM wins),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, template ORDER BY dice DESC, p) AS k FROM met) WHERE k = 1 AND dice >= {threshold!r}::DOUBLE)
SELECT doc_id, p AS word, license, template, dice FROM best x WHERE NOT EXISTS (SELECT 1 FROM best y WHERE y.r = x.r AND y.p <= x.p + x.width AND x.p <= y.p + y.width AND (y.dice > x.dice OR (y.dice = x.dice AND y.template < x.template)))"""


def decontamination(window: int = decontam.WINDOW) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH items AS (SELECT item_id, w, least({window}, len(w)) AS n FROM (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
docs AS (SELECT doc_id, row_number() OVER () AS r, {words} AS w FROM documents),
shingles AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
met AS (SELECT s.r, s.i, s.n, w.item_id FROM shingles s JOIN wins w ON s.n = w.n AND s.k = w.k),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM met) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM docs LEFT JOIN hits USING (r) LEFT JOIN found USING (r)"""


def source_mix(seed: int = 17, weights: tuple = mixing.WEIGHTS, most: float = mixing.MOST_TIMES) -> str:
    pick = f"[{', '.join(f'{float(w)!r}::DOUBLE' for w in weights)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1]"
    return f"""WITH docs AS (SELECT *, CAST(floor(1000 * size / (size + {mixing.HALF_LIKED})) AS BIGINT) AS liking FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, CAST('0x' || left(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS dice FROM documents)),
src AS (SELECT source, source_size, {pick} AS w FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source)),
lik AS (SELECT source, CAST(sum(size * liking) AS BIGINT) AS liked FROM docs GROUP BY source),
lim AS (SELECT *, row_number() OVER o AS pos, (sum(source_size) OVER () - coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {float(most)!r}::DOUBLE) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM src WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)),
fst AS (SELECT arg_min(level, pos) AS level, min(pos) AS pos FROM lim WHERE level * w <= source_size * {float(most)!r}::DOUBLE),
tgt AS (SELECT l.source, l.source_size, CASE WHEN f.pos IS NULL OR l.pos < f.pos THEN l.source_size * {float(most)!r}::DOUBLE ELSE f.level * w END AS target FROM lim l, fst f),
rat AS (SELECT t.*, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio, CASE WHEN source_size > 0 THEN liked / source_size ELSE 0 END AS mean FROM tgt t JOIN lik l ON t.source IS NOT DISTINCT FROM l.source),
due AS (SELECT d.*, source_size, target, greatest(0, least({float(most)!r}::DOUBLE, ratio + greatest(0, least(ratio, {float(most)!r}::DOUBLE - ratio)) * (liking - mean) / 1000.0::DOUBLE)) AS due FROM docs d JOIN rat t ON d.source IS NOT DISTINCT FROM t.source),
ex AS (SELECT *, floor(due) AS whole, due - floor(due) AS part FROM due),
rk AS (SELECT *, CASE WHEN part > 0 THEN dice * (1 - part) / (dice * (1 - part) + (1 - dice) * part) ELSE 1.0 END AS rank FROM ex),
drawn AS (SELECT *, coalesce(sum(CASE WHEN part > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(whole * size) OVER (PARTITION BY source) AS certain FROM rk),
cop AS (SELECT *, CAST(whole + CASE WHEN part > 0 AND before + size / 2 <= target - certain THEN 1 ELSE 0 END AS BIGINT) AS copies FROM drawn)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM cop"""


def top_k(k: int = topk.K, scale: int = topk.SCALE) -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor({scale} * x)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""


def line_dedup(ratio: float = linededup.RATIO, least: int = linededup.LEAST_PAGES) -> str:
    text = f"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), {_quoted(linededup.SILENT)}, '', 'g'), {_quoted(linededup.BREAKS)}, chr(10), 'g'), {_quoted(linededup.TAGS)}, '', 'g')"
    for name, sign in linededup.REFERENCES:
        text = f"replace({text}, {_quoted(name)}, {_quoted(sign)})"
    text = f"trim(regexp_replace(regexp_replace({text}, {_quoted(linededup.SPACES)}, ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"
    return f"""WITH p AS (SELECT row_number() OVER () AS r, page_id, url, lower(regexp_extract(coalesce(url, ''), {_quoted(linededup.HOST)}, 1)) AS host, list_filter(string_split({text}, chr(10)), lambda x: x <> '') AS ls FROM pages),
tot AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
cnt AS (SELECT host, line, count(*) AS n FROM (SELECT DISTINCT r, host, unnest(ls) AS line FROM p) GROUP BY ALL),
com AS (SELECT host, list(line) AS common FROM cnt JOIN tot USING (host) WHERE n >= {least} AND n > {ratio!r}::DOUBLE * pages GROUP BY host),
k AS (SELECT p.*, list_filter(ls, lambda x: NOT list_contains(coalesce(common, CAST([] AS VARCHAR[])), x)) AS kept FROM p LEFT JOIN com USING (host))
SELECT page_id, url, host, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(kept) AS BIGINT) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM k"""


def ranked_search(k: int = search.K) -> str:
    terms = f"unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
t AS (SELECT r, t, count(*) AS tf FROM (SELECT r, {terms} AS t FROM d) GROUP BY ALL),
n AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY r),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
i AS (SELECT row_number() OVER () AS i, item_id, text FROM benchmark),
q AS (SELECT i, t, count(*) AS times FROM (SELECT i, {terms} AS t FROM i) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, a WHERE t IN (SELECT t FROM q) GROUP BY t, docs),
m AS (SELECT r, {search.PERCENT - search.SLOPE} + ({search.SLOPE} * n * docs) // words AS m FROM n, a),
s AS (SELECT i, r, CAST(sum(times * w * (({search.UNIT} * tf) // (1000 * tf + {search.SATURATION} * m))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN t USING (t) JOIN m USING (r) GROUP BY i, r),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k JOIN i USING (i) WHERE rank <= {k}"""


def release_order() -> str:
    """Turn after turn by recursion; CRC-32 by its table, byte after byte."""
    crc = lambda codes: f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)"
    text = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    name = "concat(k, ':', coalesce(CAST(conv_id AS VARCHAR), 'null'), ':', coalesce(CAST(turn AS VARCHAR), 'null'))"
    delays, n = list(release.DELAYS), len(release.DELAYS)
    tries = f"list_filter(range(1, {n + 1}), lambda a: NOT faulty OR (good[a] AND b + {delays}[a] >= repaired))"
    return f"""WITH RECURSIVE table_of AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
body AS (SELECT conv_id, turn, {crc(text)} AS crc FROM conversations, table_of),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, crc) - 1 AS p FROM body),
hs AS (SELECT num.*, list_transform(range({n + 3}), lambda k: {crc("list_transform(string_split(" + name + ", ''), lambda x: CAST(ascii(x) AS BIGINT))")}) AS h FROM num, table_of),
plan AS (SELECT conv_id, turn, crc, p, {release.ARRIVAL_STEP} * p AS arrival, CASE WHEN h[1] % {release.REACH} BETWEEN 1 AND p THEN h[1] % {release.REACH} END AS back, h[2] % {release.FAULT_MODULUS} < {release.FAULTY_BELOW} AS faulty, {release.ARRIVAL_STEP} * p + h[3] % {release.REPAIR_MODULUS} AS repaired, list_transform(h[4:], lambda x: x % {release.FAIL_MODULUS} <> 0) AS good FROM hs),
run AS (SELECT conv_id, turn, crc, p, arrival, faulty, repaired, good, CAST(NULL AS BIGINT) AS d0, CAST(NULL AS BIGINT) AS d1, CAST(NULL AS BIGINT) AS d2, CAST(NULL AS BIGINT) AS back, FALSE AS blocked, CAST(NULL AS BIGINT) AS b, -1::BIGINT AS upto, CAST([] AS BIGINT[]) AS ok FROM plan WHERE p = 0
UNION ALL SELECT conv_id, turn, crc, p, arrival, faulty, repaired, good, CASE WHEN NOT blocked AND len(ok) > 0 THEN b + {delays}[ok[1]] END, d1, d2, back, blocked, b, p, ok FROM (SELECT *, CAST({tries} AS BIGINT[]) AS ok FROM (SELECT q.conv_id, q.turn, q.crc, q.p, q.arrival, q.faulty, q.repaired, q.good, q.back, r.d0 AS d1, r.d1 AS d2, q.back IS NOT NULL AND CASE q.back WHEN 1 THEN r.d0 ELSE r.d1 END IS NULL AS blocked, greatest(q.arrival, coalesce(CASE q.back WHEN 1 THEN r.d0 WHEN 2 THEN r.d1 END, q.arrival)) AS b FROM run r JOIN plan q ON r.conv_id IS NOT DISTINCT FROM q.conv_id AND q.p = r.upto + 1))),
done AS (SELECT conv_id, turn, crc, p, CASE WHEN blocked THEN 'blocked' WHEN d0 IS NULL THEN 'dead' ELSE 'delivered' END AS status, CAST(CASE WHEN blocked THEN 0 WHEN d0 IS NULL THEN {n} ELSE ok[1] END AS INTEGER) AS attempts, CASE WHEN NOT blocked THEN b END AS first_at, CASE WHEN NOT blocked THEN coalesce(d0, b + {delays[-1]}) END AS last_at FROM run WHERE upto >= 0),
ord AS (SELECT conv_id, p, row_number() OVER o AS release_no, crc FROM done WHERE status = 'delivered' WINDOW o AS (PARTITION BY conv_id ORDER BY last_at, turn NULLS FIRST, p)),
tot AS (SELECT conv_id, p, release_no, CAST(sum(release_no * crc) OVER (PARTITION BY conv_id ORDER BY release_no) AS BIGINT) AS state FROM ord)
SELECT d.conv_id, d.turn, status, attempts, first_at, last_at, release_no, state FROM done d LEFT JOIN tot t ON d.conv_id IS NOT DISTINCT FROM t.conv_id AND d.p = t.p"""
