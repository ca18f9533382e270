"""The adapters of ``sources.tables`` once more in DuckDB's SQL, as common table expressions."""

CTES = {
    "ev": ((), """SELECT user_id AS recording_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, event_id,
        CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS cls, CAST(200 + floor(value * 10) AS BIGINT) AS dur, value AS level FROM events"""),
    "spans": (("ev",), """SELECT recording_id, idx, cls, n_sp, level, start_ms, start_ms + dur AS end_ms, dur FROM (SELECT *, CASE WHEN cls = 0 THEN 0 WHEN cls = 4 THEN 2 ELSE 1 END AS n_sp,
        CAST(coalesce(sum(dur) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM ev)"""),
    "usable": (("spans",), "SELECT * FROM spans WHERE n_sp = 1 AND dur >= 800"),
    "ovl": (("spans",), "SELECT * FROM spans WHERE n_sp > 1"),
    "before": (("usable", "ovl"), "SELECT o.recording_id, o.idx, o.start_ms, o.end_ms, u.idx AS b_idx, u.end_ms AS b_end FROM ovl o ASOF LEFT JOIN usable u ON o.recording_id = u.recording_id AND u.end_ms <= o.start_ms + 1"),
    "beforeafter": (("before", "usable"), "SELECT o.*, u.idx AS a_idx, u.start_ms AS a_start FROM before o ASOF LEFT JOIN usable u ON o.recording_id = u.recording_id AND u.start_ms >= o.end_ms - 1"),
    "credited": (("usable", "before"), "SELECT u.*, u.cls - 1 AS label, coalesce(c.ms, 0) AS credited_ms FROM usable u LEFT JOIN (SELECT recording_id, b_idx, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms FROM before WHERE b_idx IS NOT NULL GROUP BY ALL) c ON u.recording_id = c.recording_id AND u.idx = c.b_idx"),
    "samples": ((), "SELECT CAST(floor(vec_id / 50) AS BIGINT) AS recording_id, vec_id AS idx, vec_id * 5000 AS start_ms, 800 + (vec_id * 37) % 4200 AS duration_ms, vec_id * 5000 + 800 + (vec_id * 37) % 4200 AS end_ms, label AS truth, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings"),
    "parts": (("samples",), "SELECT recording_id, idx, duration_ms, truth, unnest(vector) AS x, generate_subscripts(vector, 1) AS d FROM samples"),
    "trn": ((), """SELECT recording_id, idx, speaker, start_ms, start_ms + dur AS end_ms, dur FROM (SELECT conv_id AS recording_id, turn AS idx, role AS speaker, length(text) * 10 AS dur,
        CAST(coalesce(sum(length(text) * 10) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM conversations)"""),
    "hyp": (("trn",), "SELECT recording_id, idx, start_ms + 500 AS start_ms, end_ms + 500 AS end_ms, dur, CASE WHEN idx % 5 = 4 THEN CASE speaker WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' ELSE 'user' END ELSE speaker END AS speaker FROM trn"),
    "tot": (("trn",), "SELECT recording_id, max(end_ms) AS total_ms FROM trn GROUP BY ALL"),
    "frm": (("ev",), "SELECT recording_id, idx AS frame, list_transform([0,1,2,3,4,5,6], lambda c: CAST(((event_id // 3) * (31 + 7 * c) + 13 * c) % 17 AS DOUBLE)) AS logits FROM ev"),
    "rref": (("trn", "tot"), "SELECT recording_id, frame, arg_max(speaker, (dur, idx)) AS speaker FROM (SELECT t.*, unnest(range(CAST(floor(start_ms / 10) AS BIGINT), CAST(least(ceil(total_ms / 10), ceil(end_ms / 10)) AS BIGINT))) AS frame FROM trn t JOIN tot USING (recording_id)) GROUP BY ALL"),
    "rhyp": (("hyp", "tot"), "SELECT recording_id, frame, arg_max(speaker, (dur, idx)) AS speaker FROM (SELECT t.*, unnest(range(CAST(floor(start_ms / 10) AS BIGINT), CAST(least(ceil(total_ms / 10), ceil(end_ms / 10)) AS BIGINT))) AS frame FROM hyp t JOIN tot USING (recording_id)) GROUP BY ALL"),
    "lab": (("samples",), "SELECT *, CASE WHEN idx % 7 = 3 THEN -1 ELSE truth % 4 END AS label FROM samples"),
    "cent": (("lab",), "SELECT recording_id, label, list_transform(v, lambda x: x / n) AS centroid FROM (SELECT recording_id, label, list(s ORDER BY d) AS v, sqrt(sum(s * s)) AS n FROM (SELECT recording_id, label, d, sum(x * duration_ms) AS s FROM (SELECT recording_id, label, duration_ms, unnest(vector) AS x, generate_subscripts(vector, 1) AS d FROM lab WHERE label <> -1) GROUP BY ALL) GROUP BY ALL)"),
    "cvec": (("parts",), "SELECT recording_id, idx, duration_ms, CASE WHEN idx % 7 = 3 THEN -1 ELSE truth % 4 END AS label, list(CASE WHEN n = 0 THEN y ELSE y / n END ORDER BY d) AS vector FROM (SELECT *, sqrt(sum(y * y) OVER (PARTITION BY recording_id, idx)) AS n FROM (SELECT *, x - avg(x) OVER (PARTITION BY recording_id, d) AS y FROM parts)) GROUP BY recording_id, idx, duration_ms, truth"),
    "ccen": (("cvec",), "SELECT recording_id, label, list_transform(v, lambda x: x / n) AS centroid FROM (SELECT recording_id, label, list(s ORDER BY d) AS v, sqrt(sum(s * s)) AS n FROM (SELECT recording_id, label, d, sum(x * duration_ms) AS s FROM (SELECT recording_id, label, duration_ms, unnest(vector) AS x, generate_subscripts(vector, 1) AS d FROM cvec WHERE label <> -1) GROUP BY ALL) GROUP BY ALL)"),
}


def sql(body: str, *uses: str) -> str:
    """``body`` under the expressions that it uses, and those that these use."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in CTES[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in uses:
        need(name)
    return ("WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" if order else "") + body
