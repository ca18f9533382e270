"""All queries of the engine by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import constants as C, scalars, tables as table_functions
from ..functions.vectors import nearest_rank
from ..operators import cluster, controls, field, identity, interval, reports, score, segments, tally, timeline, vectors
from ..sources import tables
from .prelude import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(body: str | None = None, *uses: str):
    """Registers a query under its function's name, with its SQL if there is any."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if body is not None:
            ORACLE_SQL[f.__name__] = sql(body, *uses)
        return f

    return put


def _recursive(body: str, *uses: str) -> str:
    return sql("", *uses).rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + body


def _six(column: str):
    return F.round(column, 6).alias(column)


def _usable(spark: SparkSession, d: str) -> DataFrame:
    return timeline.single_speaker(tables.spans(spark, d)).withColumns({"label": F.col("speakers")[0], "duration_ms": F.col("end_ms") - F.col("start_ms")})


def _credited(spark: SparkSession, d: str) -> DataFrame:
    return interval.credit_overlap(_usable(spark, d), timeline.overlapped(tables.spans(spark, d)))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return tables.samples(spark, d).withColumn("label", F.when(F.col("idx") % 7 == 3, -1).otherwise(F.col("truth") % 4))


# --- shares ------------------------------------------------------------------------------------


@query("SELECT recording_id, label AS speaker, CAST(sum(dur + credited_ms) AS BIGINT) AS total_ms, count(*) AS segments, round(sum(dur + credited_ms) / sum(sum(dur + credited_ms)) OVER (PARTITION BY recording_id), 6) AS share FROM credited GROUP BY recording_id, label", "credited")
def floor_share(spark, d):
    return tally.shares(_credited(spark, d)).withColumn("share", F.round("share", 6))


@query("SELECT recording_id, idx, cls - 1 AS speaker, start_ms, end_ms FROM usable", "usable")
def single_speaker_spans(spark, d):
    return _usable(spark, d).select("recording_id", "idx", F.col("label").alias("speaker"), "start_ms", "end_ms")


@query("SELECT recording_id, idx, start_ms, end_ms FROM ovl", "ovl")
def overlap_spans(spark, d):
    return timeline.overlapped(tables.spans(spark, d)).select("recording_id", "idx", "start_ms", "end_ms")


@query("SELECT recording_id, CAST(sum(dur) AS BIGINT) AS silence_ms, count(*) AS pauses FROM spans WHERE n_sp = 0 GROUP BY ALL", "spans")
def silence_total(spark, d):
    return timeline.silent(tables.spans(spark, d)).groupBy("recording_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("silence_ms"), F.count("*").alias("pauses"))


@query("SELECT recording_id, CAST(sum(CASE WHEN label = 2 THEN dur + credited_ms ELSE 0 END) AS BIGINT) AS other_voices_ms FROM credited GROUP BY ALL", "credited")
def other_voices_total(spark, d):
    return tally.other_voices(_credited(spark, d).withColumn("label", F.when(F.col("label") == 2, C.OTHER_VOICE).otherwise(F.col("label"))))


@query("SELECT p.recording_id, p.speaker, coalesce(t.ms, 0) AS total_ms, coalesce(t.n, 0) AS segments FROM (SELECT DISTINCT recording_id, unnest([0, 1, 2]) AS speaker FROM spans) p LEFT JOIN (SELECT recording_id, label, CAST(sum(dur + credited_ms) AS BIGINT) AS ms, count(*) AS n FROM credited GROUP BY ALL) t ON p.recording_id = t.recording_id AND p.speaker = t.label", "credited", "spans")
def profile_tally(spark, d):
    people = tables.spans(spark, d).select("recording_id").distinct().select("recording_id", F.explode(F.array(*(F.lit(i) for i in range(3)))).alias("speaker"))
    return tally.with_profiles(tally.shares(_credited(spark, d)), people).select("recording_id", "speaker", "total_ms", "segments")


@query("SELECT recording_id, label AS speaker, CAST(sum(dur + credited_ms) AS BIGINT) AS total_ms, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY sum(dur + credited_ms) DESC, min(start_ms), label) AS INTEGER) AS rank FROM credited GROUP BY recording_id, label", "credited")
def ordered_shares(spark, d):
    credited = _credited(spark, d)
    first = credited.groupBy("recording_id", F.col("label").alias("speaker")).agg(F.min("start_ms").alias("first_ms"))
    return tally.ordered(tally.shares(credited), first).select("recording_id", "speaker", "total_ms", "rank")


# --- timeline ----------------------------------------------------------------------------------

_WINDOWS = """plan AS (SELECT recording_id, t, unnest(CASE WHEN t <= 10000 THEN [0.0::DOUBLE] ELSE list_concat(list_transform(range(0, CAST(floor((t - 10000) / 5000) AS BIGINT) + 1), lambda i: i * 5000.0::DOUBLE), CASE WHEN floor((t - 10000) / 5000) * 5000 + 10000 < t THEN [t - 10000] ELSE CAST([] AS DOUBLE[]) END) END) AS s FROM (SELECT recording_id, CAST(max(end_ms) AS DOUBLE) AS t FROM spans GROUP BY ALL)),
win AS (SELECT recording_id, CAST(row_number() OVER w - 1 AS INTEGER) AS "window", s AS start_ms, least(s + 10000, t) AS end_ms, coalesce((s + lag(s) OVER w + 10000) / 2, 0) AS trust_from_ms, coalesce((lead(s) OVER w + s + 10000) / 2, t) AS trust_to_ms FROM plan WINDOW w AS (PARTITION BY recording_id ORDER BY s))"""


def _with_windows(body: str) -> str:
    return sql("", "spans").rstrip() + ",\n" + _WINDOWS + "\n" + body


def _windows(spark, d):
    return timeline.window_plan(tables.totals(tables.spans(spark, d)))


@query()
def window_plan(spark, d):
    return _windows(spark, d)


ORACLE_SQL["window_plan"] = _with_windows("SELECT * FROM win")


@query()
def trust_clip(spark, d):
    w = _windows(spark, d)
    met = interval.overlap_join(tables.spans(spark, d).select("recording_id", "idx", "cls", "start_ms", "end_ms"), w.select("recording_id", "window", F.col("trust_from_ms").alias("start_ms"), F.col("trust_to_ms").alias("end_ms")))
    cut = timeline.clip(met.withColumnsRenamed({"b_start_ms": "trust_from_ms", "b_end_ms": "trust_to_ms"}))
    return cut.select("recording_id", "idx", F.col("b_window").alias("window"), "start_ms", "end_ms")


ORACLE_SQL["trust_clip"] = _with_windows('SELECT s.recording_id, s.idx, w."window", greatest(s.start_ms, trust_from_ms) AS start_ms, least(s.end_ms, trust_to_ms) AS end_ms FROM spans s JOIN win w ON s.recording_id = w.recording_id AND s.start_ms < trust_to_ms AND s.end_ms > trust_from_ms')


@query("SELECT recording_id, frame, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS cls FROM frm", "frm")
def frame_argmax(spark, d):
    return tables.frames(spark, d).select("recording_id", "frame", timeline.arg_max(F.col("logits")).alias("cls"))


@query("SELECT recording_id, CAST(run - 1 AS INTEGER) AS idx, any_value(cls) AS cls, min(frame) * 100 AS start_ms, (max(frame) + 1) * 100 AS end_ms, count(*) AS n_frames FROM (SELECT *, sum(fresh) OVER (PARTITION BY recording_id ORDER BY frame) AS run FROM (SELECT *, CASE WHEN lag(cls) OVER (PARTITION BY recording_id ORDER BY frame) = cls THEN 0 ELSE 1 END AS fresh FROM (SELECT recording_id, frame, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS cls FROM frm))) GROUP BY recording_id, run", "frm")
def span_islands(spark, d):
    f = tables.frames(spark, d).select("recording_id", "frame", timeline.arg_max(F.col("logits")).alias("cls"), (F.col("frame") * 100).alias("start_ms"), ((F.col("frame") + 1) * 100).alias("end_ms"))
    return timeline.merge_runs(f, ["recording_id"], "frame", "cls")


@query("SELECT recording_id, bias, cls, count(*) AS frames FROM (SELECT recording_id, bias, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS cls FROM (SELECT recording_id, bias, list_concat([logits[1] - bias], logits[2:]) AS l FROM frm, (SELECT unnest([0.0::DOUBLE, 0.5, 1.0, 1.5, 2.0, 3.0]) AS bias))) GROUP BY ALL", "frm")
def silence_bias(spark, d):
    each = tables.frames(spark, d).withColumn("bias", F.explode(F.array(*(F.lit(b) for b in C.SILENCE_BIASES))))
    return each.groupBy("recording_id", "bias", timeline.arg_max(timeline.biased(F.col("logits"), F.col("bias"))).alias("cls")).agg(F.count("*").alias("frames"))


@query("SELECT u.recording_id, idx, n < 4 OR level >= 0.45 * m AS keep FROM usable u JOIN (SELECT recording_id, median(level) AS m, count(*) AS n FROM usable GROUP BY ALL) USING (recording_id)", "usable")
def foreground_filter(spark, d):
    return timeline.foreground(_usable(spark, d)).select("recording_id", "idx", "keep")


@query("SELECT recording_id, idx, piece, start_ms, end_ms FROM (SELECT recording_id, idx, unnest(range(0, n)) AS piece, start_ms + unnest(range(0, n)) * 1000.0 AS start_ms, CASE WHEN dur <= 2000 THEN end_ms ELSE least(start_ms + unnest(range(0, n)) * 1000 + 2000, end_ms) END AS end_ms FROM (SELECT *, CASE WHEN dur <= 2000 THEN 1 ELSE CAST(floor((dur + 500 - 2000) / 1000) AS BIGINT) + 1 END AS n FROM usable))", "usable")
def subwindows(spark, d):
    out = timeline.sub_windows(_usable(spark, d), 2000, 1000)
    return out.select("recording_id", "idx", F.col("piece").cast("long").alias("piece"), "start_ms", F.col("end_ms").cast("long").alias("end_ms"))


@query()
def window_plan_function(spark, d):
    table_functions.register(spark)
    return spark.sql("SELECT t.recording_id, w.* FROM {totals} t, LATERAL window_plan(CAST(t.total_ms AS DOUBLE)) w", totals=tables.totals(tables.spans(spark, d)))


ORACLE_SQL["window_plan_function"] = ORACLE_SQL["window_plan"]


@query()
def subwindows_function(spark, d):
    table_functions.register(spark)
    return spark.sql("SELECT u.recording_id, u.idx, CAST(w.piece AS BIGINT) AS piece, w.start_ms, CAST(w.end_ms AS BIGINT) AS end_ms FROM {spans} u, LATERAL sub_windows(CAST(u.start_ms AS DOUBLE), CAST(u.end_ms AS DOUBLE), 2000, 1000) w", spans=_usable(spark, d).select("recording_id", "idx", "start_ms", "end_ms"))


ORACLE_SQL["subwindows_function"] = ORACLE_SQL["subwindows"]


@query()
def span_runs_function(spark, d):
    table_functions.register(spark)
    f = tables.frames(spark, d).select("recording_id", F.col("frame").cast("long").alias("frame"), timeline.arg_max(F.col("logits")).alias("cls"), (F.col("frame") * 100).cast("long").alias("start_ms"), ((F.col("frame") + 1) * 100).cast("long").alias("end_ms"))
    return spark.sql("SELECT * FROM span_runs(TABLE({frames}) PARTITION BY recording_id ORDER BY frame)", frames=f)


ORACLE_SQL["span_runs_function"] = ORACLE_SQL["span_islands"]


@query("SELECT recording_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_spans FROM (SELECT *, sum(fresh) OVER (PARTITION BY recording_id ORDER BY idx) AS run FROM (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY recording_id ORDER BY idx) < 60 THEN 0 ELSE 1 END AS fresh FROM usable)) GROUP BY recording_id, run", "usable")
def touching_merge(spark, d):
    return timeline.merge_touching(_usable(spark, d), 60).select("recording_id", "start_ms", "end_ms", "n_spans")


@query("SELECT recording_id, label AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_spans FROM (SELECT *, sum(fresh) OVER (PARTITION BY recording_id, label ORDER BY idx) AS run FROM (SELECT *, cls - 1 AS label, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY recording_id, cls ORDER BY idx) < 1500 THEN 0 ELSE 1 END AS fresh FROM usable)) GROUP BY recording_id, label, run", "usable")
def speaking_turns(spark, d):
    return timeline.speaking_turns(_usable(spark, d).withColumn("speaker", F.col("label"))).select("recording_id", "speaker", "start_ms", "end_ms", "n_spans")


@query("SELECT recording_id, m AS minutes, count(*) AS spans, CAST(sum(dur) AS BIGINT) AS ms FROM usable, (SELECT unnest([1.5::DOUBLE, 3, 5, 8, 11, 14, 17.5]) AS m) WHERE end_ms <= m * 60000 GROUP BY ALL", "usable")
def prefix_growth(spark, d):
    each = _usable(spark, d).withColumn("minutes", F.explode(F.array(*(F.lit(float(m)) for m in C.GROWTH_MINUTES))))
    return each.where(F.col("end_ms") <= F.col("minutes") * 60_000).groupBy("recording_id", "minutes").agg(F.count("*").alias("spans"), F.sum("duration_ms").alias("ms"))


@query("SELECT recording_id, idx, speaker, CAST(trunc((greatest(start_ms / 1000, 5.0::DOUBLE) - 5.0::DOUBLE) * 1000) AS BIGINT) AS start_ms, CAST(trunc((least(end_ms / 1000, 65.0::DOUBLE) - 5.0::DOUBLE) * 1000) AS BIGINT) AS end_ms FROM trn WHERE least(end_ms, 65000) > greatest(start_ms, 5000)", "trn")
def excerpt(spark, d):
    t = tables.turns(spark, d).select("recording_id", "idx", "speaker", (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"))
    return timeline.excerpt(t, 5.0, 60.0).select("recording_id", "idx", "speaker", "start_ms", "end_ms")


# --- totals and flags ---------------------------------------------------------------------------


@query("""SELECT recording_id, count(*) AS spans, count(*) FILTER (n_sp = 1) AS single_speaker, count(*) FILTER (n_sp = 1 AND dur >= 800) AS long_enough, count(*) FILTER (n_sp = 1 AND dur >= 800 AND keep) AS foreground,
CAST(coalesce(sum(dur) FILTER (n_sp = 0), 0) AS BIGINT) AS silence_ms, CAST(coalesce(sum(dur) FILTER (n_sp > 1), 0) AS BIGINT) AS overlap_ms, CAST(coalesce(sum(dur) FILTER (n_sp = 1), 0) AS BIGINT) AS speech_ms, CAST(coalesce(sum(dur) FILTER (n_sp = 1 AND dur >= 800 AND NOT keep), 0) AS BIGINT) AS background_ms,
max(dur) FILTER (n_sp = 1) AS longest_ms, CAST(coalesce(sum(dur) FILTER (n_sp = 1), 0) - coalesce(sum(dur) FILTER (n_sp = 1 AND dur >= 800 AND keep), 0) AS BIGINT) AS discarded_ms
FROM (SELECT s.*, coalesce(n < 4 OR level >= 0.45 * m, true) AS keep FROM spans s LEFT JOIN (SELECT recording_id, median(level) AS m, count(*) AS n FROM usable GROUP BY ALL) USING (recording_id)) GROUP BY recording_id""", "spans", "usable")
def stage_counters(spark, d):
    whole = _usable(spark, d).groupBy("recording_id").agg(F.median("level").alias("m"), F.count("*").alias("n"))
    s = tables.spans(spark, d).join(whole, "recording_id", "left")
    keep = F.coalesce((F.col("n") < C.LOUDNESS_MIN_LEVELS) | (F.col("level") >= C.LOUDNESS_RATIO * F.col("m")), F.lit(True))
    return tally.stage_counters(s.withColumn("keep", keep))


@query("SELECT recording_id, metric, value FROM (SELECT recording_id, count(*) AS spans, count(*) FILTER (n_sp = 1) AS single_speaker, CAST(coalesce(sum(dur) FILTER (n_sp > 1), 0) AS BIGINT) AS overlap_ms FROM spans GROUP BY ALL) UNPIVOT (value FOR metric IN (spans, single_speaker, overlap_ms))", "spans")
def diagnostics_panel(spark, d):
    wide = tally.stage_counters(tables.spans(spark, d).withColumn("keep", F.lit(True))).select("recording_id", "spans", "single_speaker", "overlap_ms")
    return wide.unpivot("recording_id", ["spans", "single_speaker", "overlap_ms"], "metric", "value")


@query("SELECT recording_id, round(coalesce(sum(credited_ms) / nullif(sum(dur + credited_ms), 0), 0), 6) AS overlap_share, coalesce(sum(credited_ms) / nullif(sum(dur + credited_ms), 0), 0) > 0.3 AS heavy FROM credited GROUP BY ALL", "credited")
def overlap_share_flag(spark, d):
    return tally.overlap_flag(_credited(spark, d)).withColumn("overlap_share", F.round("overlap_share", 6))


@query("SELECT recording_id, count(*) AS samples, count(DISTINCT label) AS speakers, CASE WHEN count(*) < 2 OR count(DISTINCT label) = 0 THEN 'insufficient' WHEN count(*) / count(DISTINCT label) < 3 THEN 'low' ELSE 'good' END AS reliability FROM credited GROUP BY ALL", "credited")
def reliability(spark, d):
    return tally.reliability_of(_usable(spark, d))


@query("SELECT conv_id AS recording_id, CASE WHEN conv_id % 4 >= 2 THEN CAST(conv_id % 4 AS INTEGER) WHEN conv_id % 6 >= 2 THEN CAST(conv_id % 6 AS INTEGER) WHEN n >= 2 THEN CAST(n AS INTEGER) ELSE 0 END AS k, CASE WHEN conv_id % 4 >= 2 THEN 'calibrated' WHEN conv_id % 6 >= 2 THEN 'count' WHEN n >= 2 THEN 'names' ELSE 'automatic' END AS source FROM (SELECT conv_id, count(DISTINCT role) AS n FROM conversations GROUP BY ALL)")
def resolve_count(spark, d):
    c = tables.turns(spark, d).groupBy("recording_id").agg(F.collect_set("speaker").alias("names"))
    hint = scalars.resolve_count(F.col("recording_id") % 4, F.col("recording_id") % 6, F.col("names"))
    return c.select("recording_id", F.coalesce(hint["k"], F.lit(0)).alias("k"), hint["source"].alias("source"))


@query("""SELECT recording_id, CASE WHEN reliability <> 'good' THEN 'reliability-' || reliability WHEN heavy THEN 'overlap' ELSE '' END AS warning FROM (SELECT recording_id, CASE WHEN count(*) < 2 THEN 'insufficient' WHEN count(*) / count(DISTINCT label) < 3 THEN 'low' ELSE 'good' END AS reliability, sum(credited_ms) / sum(dur + credited_ms) > 0.3 AS heavy FROM credited GROUP BY ALL)""", "credited")
def file_warnings(spark, d):
    both = tally.reliability_of(_usable(spark, d)).join(tally.overlap_flag(_credited(spark, d)), "recording_id")
    return both.select("recording_id", scalars.file_warning(F.col("reliability"), F.col("heavy")).alias("warning"))


@query()
def legend(spark, d):
    s = tally.shares(_credited(spark, d))
    return s.select("recording_id", "speaker", scalars.clock(F.col("total_ms")).alias("clock"), scalars.percent(F.col("share")).alias("percent"), scalars.palette(F.col("speaker")).alias("colour"))


ORACLE_SQL["legend"] = sql("SELECT recording_id, label AS speaker, CAST(s // 60 AS VARCHAR) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock, CAST(floor(CAST(ms AS DOUBLE) / sum(ms) OVER (PARTITION BY recording_id) * 100 + 0.5) AS BIGINT) AS percent, label % 8 AS colour FROM (SELECT recording_id, label, CAST(sum(dur + credited_ms) AS BIGINT) AS ms, CAST(floor(sum(dur + credited_ms) / 1000.0 + 0.5) AS BIGINT) AS s FROM credited GROUP BY ALL)", "credited")

# --- as-of joins --------------------------------------------------------------------------------


def _rule(name: str, body: str) -> None:
    def run(spark, d):
        owned = interval.overlap_owners(timeline.overlapped(tables.spans(spark, d)), _usable(spark, d)).where(F.col("rule") == name)
        return owned.select("recording_id", "idx", "owner", "start_ms", "end_ms")

    key = f"asof_{name}"
    QUERIES[key] = run
    ORACLE_SQL[key] = sql(body, "beforeafter")


_rule("before", "SELECT recording_id, idx, b_idx AS owner, CAST(start_ms AS DOUBLE) AS start_ms, CAST(end_ms AS DOUBLE) AS end_ms FROM beforeafter WHERE b_idx IS NOT NULL")
_rule("after", "SELECT recording_id, idx, a_idx AS owner, CAST(start_ms AS DOUBLE) AS start_ms, CAST(end_ms AS DOUBLE) AS end_ms FROM beforeafter WHERE a_idx IS NOT NULL")
_rule("nearer", "SELECT recording_id, idx, owner, CAST(start_ms AS DOUBLE) AS start_ms, CAST(end_ms AS DOUBLE) AS end_ms FROM (SELECT *, CASE WHEN b_idx IS NOT NULL AND (a_idx IS NULL OR start_ms - b_end <= a_start - end_ms) THEN b_idx ELSE a_idx END AS owner FROM beforeafter) WHERE owner IS NOT NULL")
_rule("split", "SELECT recording_id, idx, b_idx AS owner, CAST(start_ms AS DOUBLE) AS start_ms, (start_ms + end_ms) / 2 AS end_ms FROM beforeafter WHERE b_idx IS NOT NULL UNION ALL SELECT recording_id, idx, a_idx, (start_ms + end_ms) / 2, CAST(end_ms AS DOUBLE) FROM beforeafter WHERE a_idx IS NOT NULL")
_rule("within_1s", "SELECT recording_id, idx, b_idx AS owner, CAST(start_ms AS DOUBLE) AS start_ms, CAST(end_ms AS DOUBLE) AS end_ms FROM beforeafter WHERE start_ms - b_end < 1000")


@query("SELECT rule, count(*) AS overlaps, sum(ms) AS ms FROM (SELECT 'before' AS rule, CAST(end_ms - start_ms AS DOUBLE) AS ms FROM beforeafter WHERE b_idx IS NOT NULL UNION ALL SELECT 'after', end_ms - start_ms FROM beforeafter WHERE a_idx IS NOT NULL UNION ALL SELECT 'within_1s', end_ms - start_ms FROM beforeafter WHERE start_ms - b_end < 1000 UNION ALL SELECT 'nearer', end_ms - start_ms FROM beforeafter WHERE coalesce(a_idx, b_idx) IS NOT NULL UNION ALL SELECT 'split', (end_ms - start_ms) / 2 FROM beforeafter WHERE b_idx IS NOT NULL UNION ALL SELECT 'split', (end_ms - start_ms) / 2 FROM beforeafter WHERE a_idx IS NOT NULL) GROUP BY ALL", "beforeafter")
def overlap_rule_scoreboard(spark, d):
    owned = interval.overlap_owners(timeline.overlapped(tables.spans(spark, d)), _usable(spark, d))
    return owned.groupBy("rule").agg(F.count("*").alias("overlaps"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))


@query()
def overlap_rule_error(spark, d):
    """Error rate by rule: spans of a number against the turns of the same number."""
    t = tables.turns(spark, d)
    total = tables.totals(t)
    mine = lambda rows: rows.join(total.select("recording_id"), "recording_id", "left_semi")
    usable = mine(_usable(spark, d)).withColumn("speaker", F.col("label"))
    found = score.overlap_rule_errors(t, usable, mine(timeline.overlapped(tables.spans(spark, d))), total)
    return found.withColumn("der", F.round("der", 6))


# --- control events ------------------------------------------------------------------------------


@query()
def introductions(spark, d):
    """Events as a page's buttons and as speech: a click is 'next', a signup 'add', every sixth error 'skip', other errors notes."""
    s = tables.spans(spark, d)
    verb = F.when(F.col("cls") == 0, "add").when(F.col("cls") == 1, "next").when((F.col("cls") == 4) & (F.col("idx") % 6 == 5), "skip").when(F.col("cls") == 4, "muted")
    told = s.select("recording_id", "idx", F.col("start_ms").alias("at_ms"), verb.alias("verb")).where("verb is not null")
    speech = s.where("cls in (2, 3)").select("recording_id", F.col("end_ms").alias("at_ms"), (F.col("end_ms") - F.col("start_ms")).alias("ms"))
    names = s.select("recording_id", F.pmod("recording_id", F.lit(4)).alias("people")).distinct()
    return controls.introductions(told, speech, names)


ORACLE_SQL["introductions"] = sql("", "spans").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
heard AS (SELECT recording_id, idx, cls, CAST(coalesce(sum(CASE WHEN cls IN (2, 3) THEN dur END) OVER (PARTITION BY recording_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS ms FROM spans),
c AS (SELECT recording_id, idx, ms, CASE WHEN cls = 0 THEN 'add' WHEN cls = 1 THEN 'next' WHEN idx % 6 = 5 THEN 'skip' ELSE 'muted' END AS verb, row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS r FROM heard WHERE cls IN (0, 1, 4)),
walk AS (SELECT recording_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS idx, CAST(NULL AS VARCHAR) AS verb, CAST(NULL AS BOOLEAN) AS taken, CASE WHEN n > 0 THEN 'introductions' ELSE 'conversation' END AS phase, CASE WHEN n > 0 THEN 0 END AS person, CAST(n AS INTEGER) AS people, CAST(0 AS BIGINT) AS since FROM (SELECT DISTINCT recording_id, recording_id % 4 AS n FROM c)
UNION ALL SELECT recording_id, r, idx, verb, ok, CASE WHEN ok AND ((verb = 'skip') OR (verb = 'next' AND (phase = 'conversation' OR person + 1 >= people))) THEN 'conversation' ELSE phase END,
CASE WHEN NOT coalesce(ok, false) THEN person WHEN verb = 'add' THEN people WHEN verb = 'skip' OR phase = 'conversation' OR person + 1 >= people THEN NULL ELSE person + 1 END,
CAST(people + CASE WHEN verb = 'add' THEN 1 ELSE 0 END AS INTEGER), CASE WHEN ok THEN ms ELSE since END
FROM (SELECT c.recording_id, c.r, c.idx, c.verb, c.ms, w.phase, w.person, w.people, w.since, CASE c.verb WHEN 'add' THEN true WHEN 'skip' THEN w.phase = 'introductions' WHEN 'next' THEN CASE WHEN w.phase = 'introductions' THEN c.ms - w.since >= 5000 ELSE w.person IS NOT NULL END END AS ok FROM walk w JOIN c ON c.recording_id = w.recording_id AND c.r = w.r + 1))
SELECT recording_id, idx, verb, taken, phase, person, people FROM walk WHERE r > 0"""


@query()
def results_in_time(spark, d):
    """Spans as requests answered after four times their length; an error begins a generation, in which older requests are void."""
    s = tables.spans(spark, d)
    asked = s.where("cls <> 4").select("recording_id", "idx", F.col("start_ms").alias("asked_ms"), (F.col("start_ms") + 4 * (F.col("end_ms") - F.col("start_ms"))).alias("arrived_ms"))
    fences = s.where("cls = 4").select("recording_id", F.col("start_ms").alias("at_ms"), (F.col("idx") + 1).alias("generation"))
    return controls.in_time(asked, fences)


ORACLE_SQL["results_in_time"] = sql("", "spans").rstrip() + """,
fence AS (SELECT recording_id, start_ms AS at_ms, idx + 1 AS generation FROM spans WHERE cls = 4),
asked AS (SELECT recording_id, idx, start_ms AS asked_ms, start_ms + 4 * dur AS arrived_ms FROM spans WHERE cls <> 4),
a AS (SELECT asked.*, coalesce(generation, 0) AS generation FROM asked ASOF LEFT JOIN fence ON asked.recording_id = fence.recording_id AND fence.at_ms <= asked.asked_ms)
SELECT a.* FROM a ASOF LEFT JOIN fence ON a.recording_id = fence.recording_id AND fence.at_ms <= a.arrived_ms WHERE a.generation = coalesce(fence.generation, 0)"""


# --- annotations --------------------------------------------------------------------------------

_MAJORITY = """shared AS (SELECT s.recording_id, s.idx, s.dur, t.speaker, CAST(sum(least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms)) AS BIGINT) AS ms, min(t.idx) AS f FROM hyp s JOIN trn t ON s.recording_id = t.recording_id AND t.start_ms < s.end_ms AND t.end_ms > s.start_ms GROUP BY s.recording_id, s.idx, s.dur, t.speaker),
rk AS (SELECT *, row_number() OVER (PARTITION BY recording_id, idx ORDER BY ms DESC, f) AS r FROM shared),
maj AS (SELECT s.recording_id, s.idx, CASE WHEN a.ms IS NULL THEN '?' WHEN b.ms > 0.25 * s.dur THEN 'mixed' WHEN a.ms > 0.5 * s.dur THEN a.speaker ELSE '?' END AS truth FROM hyp s LEFT JOIN rk a ON s.recording_id = a.recording_id AND s.idx = a.idx AND a.r = 1 LEFT JOIN rk b ON s.recording_id = b.recording_id AND s.idx = b.idx AND b.r = 2)"""


@query()
def overlap_majority_label(spark, d):
    return interval.majority_speaker(tables.hypothesis(spark, d), tables.turns(spark, d))


ORACLE_SQL["overlap_majority_label"] = sql("", "hyp").rstrip() + ",\n" + _MAJORITY + "\nSELECT * FROM maj"


def _updates(spark, d):
    """Updates of a live page: every 5 s from 2.5 s, who is heard by the late copy of the turns."""
    ends = tables.totals(tables.turns(spark, d)).where("total_ms >= 2500")
    points = ends.select("recording_id", F.explode(F.sequence(F.lit(2500).cast("long"), F.col("total_ms"), F.lit(5000).cast("long"))).alias("at_ms"))
    heard = interval.speaker_at(points, tables.hypothesis(spark, d)).withColumnRenamed("who", "active")
    return heard


_UPDATES = """pts AS (SELECT recording_id, unnest(range(2500, total_ms + 1, 5000)) AS at_ms FROM tot WHERE total_ms >= 2500),
upd AS (SELECT p.recording_id, p.at_ms, arg_max(h.speaker, (h.dur, -h.idx)) AS active FROM pts p LEFT JOIN hyp h ON p.recording_id = h.recording_id AND h.start_ms <= p.at_ms AND p.at_ms < h.end_ms GROUP BY ALL),
ann AS (SELECT p.recording_id, p.at_ms, p.active, arg_max(t.speaker, (t.dur, -t.idx)) AS who FROM upd p LEFT JOIN trn t ON p.recording_id = t.recording_id AND t.start_ms <= p.at_ms AND p.at_ms < t.end_ms GROUP BY ALL)"""


def _with_updates(body: str) -> str:
    return sql("", "hyp", "tot").rstrip() + ",\n" + _UPDATES + "\n" + body


@query()
def speaker_at(spark, d):
    return interval.speaker_at(_updates(spark, d), tables.turns(spark, d))


ORACLE_SQL["speaker_at"] = _with_updates("SELECT recording_id, at_ms, active, who FROM ann")


@query()
def flips(spark, d):
    return score.flips(interval.speaker_at(_updates(spark, d), tables.turns(spark, d)))


ORACLE_SQL["flips"] = _with_updates("SELECT recording_id, count(*) AS stable, count(*) FILTER (a0 <> active) AS flips FROM (SELECT *, lag(who) OVER w AS w0, lag(active) OVER w AS a0 FROM ann WINDOW w AS (PARTITION BY recording_id ORDER BY at_ms)) WHERE w0 = who AND a0 IS NOT NULL AND active IS NOT NULL GROUP BY ALL")


@query()
def now_accuracy(spark, d):
    seen = interval.speaker_at(_updates(spark, d), tables.turns(spark, d)).where("who is not null")
    return seen.groupBy("recording_id").agg(F.count("*").alias("scored"), F.count_if(F.coalesce(F.col("active") == F.col("who"), F.lit(False))).alias("right"))


ORACLE_SQL["now_accuracy"] = _with_updates('SELECT recording_id, count(*) AS scored, count(*) FILTER (active = who) AS "right" FROM ann WHERE who IS NOT NULL GROUP BY ALL')


@query()
def switch_latency(spark, d):
    found = score.switch_latencies(tables.turns(spark, d), _updates(spark, d))
    return found.withColumn("latency_ms", F.coalesce("latency_ms", F.lit(-1)))  # -1: never


ORACLE_SQL["switch_latency"] = _with_updates("""SELECT c.recording_id, c.idx, coalesce(min(u.at_ms) - any_value(c.start_ms), -1) AS latency_ms FROM (SELECT * FROM (SELECT n.recording_id, n.idx, n.start_ms, n.end_ms, n.speaker, arg_max(t.speaker, (t.dur, -t.idx)) AS was FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, idx) AS nth FROM trn) n LEFT JOIN trn t ON n.recording_id = t.recording_id AND t.start_ms <= n.start_ms - 200 AND n.start_ms - 200 < t.end_ms WHERE nth > 1 AND n.dur >= 2000 GROUP BY ALL) WHERE was IS DISTINCT FROM speaker) c
LEFT JOIN upd u ON c.recording_id = u.recording_id AND u.at_ms >= c.start_ms AND u.at_ms <= c.end_ms + 5000 AND u.active = c.speaker GROUP BY c.recording_id, c.idx""")


@query("SELECT recording_id, speaker, min(start_ms) AS first_ms FROM trn GROUP BY ALL", "trn")
def first_seen(spark, d):
    return tables.turns(spark, d).groupBy("recording_id", "speaker").agg(F.min("start_ms").alias("first_ms"))


# --- error rates --------------------------------------------------------------------------------


def _aligned(spark, d):
    t = tables.turns(spark, d)
    return score.aligned(t, tables.hypothesis(spark, d), tables.totals(t))


@query("SELECT recording_id, speaker, count(*) AS frames FROM rref GROUP BY ALL", "rref")
def rasterise(spark, d):
    t = tables.turns(spark, d)
    return score.rasterise(t, tables.totals(t)).groupBy("recording_id", "speaker").agg(F.sum("frames").alias("frames"))


@query("SELECT recording_id, count(*) FILTER (h.speaker IS NULL) * 10 AS missed_ms, count(*) FILTER (r.speaker IS NULL) * 10 AS false_alarm_ms, count(*) FILTER (r.speaker <> h.speaker) * 10 AS confusion_ms, count(*) FILTER (r.speaker = h.speaker) * 10 AS correct_ms, count(r.speaker) * 10 AS reference_ms, round(coalesce((count(*) - count(*) FILTER (r.speaker = h.speaker)) / nullif(count(r.speaker), 0), 0), 6) AS der FROM rref r FULL JOIN rhyp h USING (recording_id, frame) GROUP BY ALL", "rref", "rhyp")
def der_counters(spark, d):
    return score.error_counters(_aligned(spark, d)).withColumn("der", F.round("der", 6))


@query("SELECT recording_id, h.speaker AS hyp, r.speaker AS ref, count(*) AS n FROM rref r JOIN rhyp h USING (recording_id, frame) GROUP BY ALL", "rref", "rhyp")
def contingency(spark, d):
    return _aligned(spark, d).where("ref is not null and hyp is not null").groupBy("recording_id", "hyp", "ref").agg(F.sum("frames").alias("n"))


@query()
def greedy_match(spark, d):
    return score.match_speakers(_aligned(spark, d))


_GREEDY = sql("", "rref", "rhyp").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
pairs AS (SELECT recording_id, hyp, ref, row_number() OVER (PARTITION BY recording_id ORDER BY n DESC, hyp, ref) AS r FROM (SELECT recording_id, h.speaker AS hyp, r.speaker AS ref, count(*) AS n FROM rref r JOIN rhyp h USING (recording_id, frame) GROUP BY ALL)),
step AS (SELECT recording_id, r, [hyp] AS hs, [ref] AS rs, true AS taken, hyp, ref FROM pairs WHERE r = 1 UNION ALL SELECT p.recording_id, p.r, CASE WHEN list_contains(s.hs, p.hyp) OR list_contains(s.rs, p.ref) THEN s.hs ELSE list_append(s.hs, p.hyp) END, CASE WHEN list_contains(s.hs, p.hyp) OR list_contains(s.rs, p.ref) THEN s.rs ELSE list_append(s.rs, p.ref) END, NOT (list_contains(s.hs, p.hyp) OR list_contains(s.rs, p.ref)), p.hyp, p.ref FROM step s JOIN pairs p ON s.recording_id = p.recording_id AND p.r = s.r + 1),
matched AS (SELECT recording_id, hyp, ref AS matched FROM step WHERE taken)
"""
ORACLE_SQL["greedy_match"] = _GREEDY + "SELECT * FROM matched"


@query()
def diarization_error(spark, d):
    t = tables.turns(spark, d)
    return score.diarization_error(t, tables.hypothesis(spark, d), tables.totals(t)).withColumn("der", F.round("der", 6))


ORACLE_SQL["diarization_error"] = _GREEDY + """SELECT recording_id, count(*) FILTER (hyp IS NULL) * 10 AS missed_ms, count(*) FILTER (ref IS NULL) * 10 AS false_alarm_ms, count(*) FILTER (ref IS NOT NULL AND hyp IS NOT NULL AND NOT good) * 10 AS confusion_ms, count(*) FILTER (ref IS NOT NULL AND hyp IS NOT NULL AND good) * 10 AS correct_ms, count(ref) * 10 AS reference_ms,
round(coalesce((count(*) - count(*) FILTER (ref IS NOT NULL AND hyp IS NOT NULL AND good)) / nullif(count(ref), 0), 0), 6) AS der
FROM (SELECT coalesce(r.recording_id, h.recording_id) AS recording_id, r.speaker AS ref, h.speaker AS hyp, coalesce(m.matched = r.speaker, false) AS good FROM rref r FULL JOIN rhyp h ON r.recording_id = h.recording_id AND r.frame = h.frame LEFT JOIN matched m ON m.recording_id = coalesce(r.recording_id, h.recording_id) AND m.hyp = h.speaker) GROUP BY ALL"""


ORACLE_SQL["overlap_rule_error"] = sql("", "rref", "beforeafter").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
rules AS (SELECT unnest(['none', 'before', 'after', 'nearer', 'split', 'within_1s']) AS rule),
given AS (SELECT recording_id, idx, 'before' AS rule, b_idx AS owner, start_ms AS a, end_ms AS b FROM beforeafter
UNION ALL SELECT recording_id, idx, 'after', a_idx, start_ms, end_ms FROM beforeafter
UNION ALL SELECT recording_id, idx, 'nearer', CASE WHEN b_idx IS NOT NULL AND (a_idx IS NULL OR start_ms - b_end <= a_start - end_ms) THEN b_idx ELSE a_idx END, start_ms, end_ms FROM beforeafter
UNION ALL SELECT recording_id, idx, 'split', b_idx, start_ms, (start_ms + end_ms) / 2 FROM beforeafter
UNION ALL SELECT recording_id, idx, 'split', a_idx, (start_ms + end_ms) / 2, end_ms FROM beforeafter
UNION ALL SELECT recording_id, idx, 'within_1s', b_idx, start_ms, end_ms FROM beforeafter WHERE start_ms - b_end < 1000),
h AS (SELECT rule, recording_id, idx, CAST(start_ms AS DOUBLE) AS a, CAST(end_ms AS DOUBLE) AS b, CAST(cls - 1 AS VARCHAR) AS speaker FROM usable, rules
UNION ALL SELECT g.rule, g.recording_id, g.idx, CAST(g.a AS DOUBLE), CAST(g.b AS DOUBLE), CAST(u.cls - 1 AS VARCHAR) FROM given g JOIN usable u ON u.recording_id = g.recording_id AND u.idx = g.owner),
hf AS (SELECT rule, recording_id, frame, arg_max(speaker, (b - a, idx, a)) AS hyp FROM (SELECT h.*, unnest(range(CAST(floor(a / 10) AS BIGINT), CAST(least(ceil(total_ms / 10), ceil(b / 10)) AS BIGINT))) AS frame FROM h JOIN tot USING (recording_id)) GROUP BY ALL),
ct AS (SELECT rule, recording_id, hyp, ref, CAST(count(*) AS BIGINT) AS n FROM (SELECT rule, recording_id, frame, speaker AS ref FROM rref, rules) FULL JOIN hf USING (rule, recording_id, frame) GROUP BY ALL),
pairs AS (SELECT rule, recording_id, hyp, ref, row_number() OVER (PARTITION BY rule, recording_id ORDER BY n DESC, hyp, ref) AS r FROM ct WHERE hyp IS NOT NULL AND ref IS NOT NULL),
step AS (SELECT rule, recording_id, r, [hyp] AS hs, [ref] AS rs, true AS taken, hyp, ref FROM pairs WHERE r = 1
UNION ALL SELECT p.rule, p.recording_id, p.r, CASE WHEN list_contains(s.hs, p.hyp) OR list_contains(s.rs, p.ref) THEN s.hs ELSE list_append(s.hs, p.hyp) END, CASE WHEN list_contains(s.hs, p.hyp) OR list_contains(s.rs, p.ref) THEN s.rs ELSE list_append(s.rs, p.ref) END, NOT (list_contains(s.hs, p.hyp) OR list_contains(s.rs, p.ref)), p.hyp, p.ref FROM step s JOIN pairs p ON s.rule = p.rule AND s.recording_id = p.recording_id AND p.r = s.r + 1),
sums AS (SELECT c.rule, CAST(coalesce(sum(n) FILTER (c.hyp IS NULL), 0) AS BIGINT) * 10 AS missed_ms, CAST(coalesce(sum(n) FILTER (c.ref IS NULL), 0) AS BIGINT) * 10 AS false_alarm_ms,
CAST(coalesce(sum(n) FILTER (c.hyp IS NOT NULL AND c.ref IS NOT NULL AND m.ref IS NULL), 0) AS BIGINT) * 10 AS confusion_ms, CAST(coalesce(sum(n) FILTER (m.ref IS NOT NULL), 0) AS BIGINT) * 10 AS correct_ms, CAST(coalesce(sum(n) FILTER (c.ref IS NOT NULL), 0) AS BIGINT) * 10 AS reference_ms
FROM ct c LEFT JOIN (SELECT * FROM step WHERE taken) m ON c.rule = m.rule AND c.recording_id = m.recording_id AND c.hyp = m.hyp AND c.ref = m.ref GROUP BY c.rule)
SELECT *, round(CASE WHEN reference_ms > 0 THEN (missed_ms + false_alarm_ms + confusion_ms) / reference_ms ELSE 0 END, 6) AS der FROM sums"""


@query("SELECT recording_id, round(sum(abs(coalesce(a, 0) - coalesce(b, 0))) / 2, 6) AS share_error FROM (SELECT recording_id, speaker, sum(dur) / sum(sum(dur)) OVER (PARTITION BY recording_id) AS a FROM trn GROUP BY recording_id, speaker) FULL JOIN (SELECT recording_id, speaker, sum(dur) / sum(sum(dur)) OVER (PARTITION BY recording_id) AS b FROM hyp GROUP BY recording_id, speaker) USING (recording_id, speaker) GROUP BY ALL", "trn", "hyp")
def share_error(spark, d):
    ms = (F.col("end_ms") - F.col("start_ms")).alias("ms")
    out = score.share_error(tables.turns(spark, d).select("recording_id", "speaker", ms), tables.hypothesis(spark, d).select("recording_id", "speaker", ms))
    return out.withColumn("share_error", F.round("share_error", 6))


def _states(spark, d):
    """What the system made of the first 150 recordings' spans, to set against the turns of the same number."""
    s = tables.spans(spark, d)
    n, ms = F.size("speakers"), F.col("end_ms") - F.col("start_ms")
    return s.select("recording_id", "idx", "start_ms", "end_ms", F.when(n == 0, "silence").when(n > 1, "overlap").when(ms < C.MIN_SPEECH_MS, "short").otherwise("attributed").alias("state"))


_STATES = "st AS (SELECT recording_id, idx, start_ms, end_ms, CASE WHEN n_sp = 0 THEN 'silence' WHEN n_sp > 1 THEN 'overlap' WHEN dur < 800 THEN 'short' ELSE 'attributed' END AS state FROM spans)"


@query()
def coverage_matrix(spark, d):
    t = tables.turns(spark, d)
    return score.coverage(t, _states(spark, d), tables.totals(t))


ORACLE_SQL["coverage_matrix"] = sql("", "tot", "spans").rstrip() + ",\n" + _STATES + """,
hf AS (SELECT recording_id, frame, arg_max(state, idx) AS state FROM (SELECT recording_id, state, idx, unnest(range(CAST(floor(start_ms / 10) AS BIGINT), CAST(least(ceil(total_ms / 10), ceil(end_ms / 10)) AS BIGINT))) AS frame FROM st JOIN tot USING (recording_id)) GROUP BY ALL),
rf AS (SELECT recording_id, frame, count(*) AS n FROM (SELECT recording_id, unnest(range(CAST(floor(start_ms / 10) AS BIGINT), CAST(least(ceil(total_ms / 10), ceil(end_ms / 10)) AS BIGINT))) AS frame FROM trn JOIN tot USING (recording_id)) GROUP BY ALL)
SELECT CAST(least(coalesce(n, 0), 2) AS INTEGER) AS ref_bucket, state, count(*) AS frames FROM hf LEFT JOIN rf USING (recording_id, frame) GROUP BY ALL"""


@query()
def edge_histogram(spark, d):
    return score.edge_histogram(tables.turns(spark, d), timeline.silent(tables.spans(spark, d)))


ORACLE_SQL["edge_histogram"] = sql("", "trn", "spans").rstrip() + """,
af AS (SELECT recording_id, frame, count(*) AS n, min(least(frame * 10 + 5 - start_ms, end_ms - frame * 10 - 5)) AS edge FROM (SELECT recording_id, start_ms, end_ms, unnest(range(CAST(floor(start_ms / 10) AS BIGINT), CAST(ceil(end_ms / 10) AS BIGINT))) AS frame FROM trn WHERE end_ms > start_ms) GROUP BY ALL),
sf AS (SELECT DISTINCT recording_id, unnest(range(CAST(floor(start_ms / 10) AS BIGINT), CAST(ceil(end_ms / 10) AS BIGINT))) AS frame FROM spans WHERE n_sp = 0)
SELECT CAST(CASE WHEN edge >= 2000 THEN 4 WHEN edge >= 1000 THEN 3 WHEN edge >= 500 THEN 2 WHEN edge >= 250 THEN 1 ELSE 0 END AS INTEGER) AS bucket, count(*) AS frames FROM af SEMI JOIN sf USING (recording_id, frame) WHERE n = 1 GROUP BY ALL"""

# --- vectors ------------------------------------------------------------------------------------


@query("SELECT a.recording_id, a.idx AS a, b.idx AS b, round(1 - list_dot_product(a.vector, b.vector), 6) AS distance FROM samples a JOIN samples b ON a.recording_id = b.recording_id AND a.idx < b.idx", "samples")
def pair_distances(spark, d):
    return vectors.pair_distances(tables.samples(spark, d)).withColumn("distance", F.round("distance", 6))


_PAIRS = "prs AS (SELECT a.recording_id, a.truth = b.truth AS same, 1 - list_dot_product(a.vector, b.vector) AS distance FROM samples a JOIN samples b ON a.recording_id = b.recording_id AND a.idx < b.idx)"


def _pairs(spark, d):
    s = tables.samples(spark, d)
    name = lambda c: s.select("recording_id", F.col("idx").alias(c), F.col("truth").alias(f"t{c}"))
    return vectors.pair_distances(s).join(name("a"), ["recording_id", "a"]).join(name("b"), ["recording_id", "b"]).select("recording_id", (F.col("ta") == F.col("tb")).alias("same"), "distance")


@query()
def within_between_quantiles(spark, d):
    lists = _pairs(spark, d).groupBy("recording_id", "same").agg(F.collect_list("distance").alias("ds"))
    return lists.select("recording_id", "same", *(F.round(nearest_rank(F.col("ds"), p), 6).alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9)))


ORACLE_SQL["within_between_quantiles"] = sql("", "samples").rstrip() + ",\n" + _PAIRS + "\nSELECT recording_id, same, " + ", ".join(f"round(list_sort(list(distance))[CAST(least(floor({p} * count(*)), count(*) - 1) AS BIGINT) + 1], 6) AS p{int(p * 100)}" for p in (0.1, 0.5, 0.9)) + " FROM prs GROUP BY ALL"


@query()
def separation_gap(spark, d):
    far = F.min(F.when(~F.col("same"), F.col("distance")))
    near = F.max(F.when(F.col("same"), F.col("distance")))
    return _pairs(spark, d).groupBy("recording_id").agg(F.round(far - near, 6).alias("gap"))


ORACLE_SQL["separation_gap"] = sql("", "samples").rstrip() + ",\n" + _PAIRS + "\nSELECT recording_id, round(min(distance) FILTER (NOT same) - max(distance) FILTER (same), 6) AS gap FROM prs GROUP BY ALL"


@query("SELECT recording_id, label, d - 1 AS dim, round(x, 6) AS x FROM (SELECT recording_id, label, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS d FROM cent)", "cent")
def weighted_centroid(spark, d):
    c = vectors.centroids(_labelled(spark, d).where("label <> -1"), ["recording_id", "label"])
    return c.select("recording_id", "label", F.posexplode("centroid").alias("dim", "x")).select("recording_id", "label", F.col("dim").cast("long").alias("dim"), _six("x"))


@query("SELECT recording_id, idx, arg_min(label, (dist, label)) AS nearest, round(min(dist), 6) AS distance FROM (SELECT l.recording_id, l.idx, c.label, 1 - list_dot_product(l.vector, c.centroid) AS dist FROM lab l JOIN cent c USING (recording_id)) GROUP BY ALL", "lab", "cent")
def nearest_centroid(spark, d):
    s = _labelled(spark, d)
    near = vectors.nearest(s, vectors.centroids(s.where("label <> -1"), ["recording_id", "label"]))
    return near.select("recording_id", "idx", "nearest", _six("distance"))


@query("SELECT recording_id, idx, d - 1 AS dim, round(CASE WHEN n = 0 THEN y ELSE y / n END, 6) AS x FROM (SELECT *, sqrt(sum(y * y) OVER (PARTITION BY recording_id, idx)) AS n FROM (SELECT *, x - avg(x) OVER (PARTITION BY recording_id, d) AS y FROM parts))", "parts")
def centre_vectors(spark, d):
    v = vectors.centre(tables.samples(spark, d))
    return v.select("recording_id", "idx", F.posexplode("vector").alias("dim", "x")).select("recording_id", "idx", F.col("dim").cast("long").alias("dim"), _six("x"))


# --- grouping -----------------------------------------------------------------------------------


@query("SELECT l.recording_id, idx, CASE WHEN r <= 2 THEN r - 1 ELSE -1 END AS label FROM (SELECT *, truth % 5 AS l5 FROM samples) l JOIN (SELECT recording_id, truth % 5 AS l5, row_number() OVER (PARTITION BY recording_id ORDER BY sum(duration_ms) DESC, min(idx)) AS r FROM samples GROUP BY recording_id, truth % 5) t ON l.recording_id = t.recording_id AND l.l5 = t.l5", "samples")
def keep_busiest(spark, d):
    return cluster.keep_busiest(tables.samples(spark, d).withColumn("label", F.col("truth") % 5), 2)


@query("SELECT l.recording_id, l.idx, CASE WHEN l.label = -1 THEN n.nearest ELSE l.label END AS label FROM lab l JOIN (SELECT recording_id, idx, arg_min(label, (dist, label)) AS nearest FROM (SELECT l.recording_id, l.idx, c.label, 1 - list_dot_product(l.vector, c.centroid) AS dist FROM lab l JOIN cent c USING (recording_id)) GROUP BY ALL) n ON l.recording_id = n.recording_id AND l.idx = n.idx", "lab", "cent")
def place_splinters(spark, d):
    return cluster.place_splinters(_labelled(spark, d))


@query()
def absorb_tiny(spark, d):
    return cluster.absorb_tiny(tables.samples(spark, d).withColumn("label", F.when(F.col("idx") % 10 == 0, F.col("idx")).otherwise(F.col("truth") % 3)))


ORACLE_SQL["absorb_tiny"] = sql("", "samples").rstrip() + """,
g AS (SELECT *, CASE WHEN idx % 10 = 0 THEN idx ELSE truth % 3 END AS label FROM samples),
h AS (SELECT recording_id, label, count(*) >= 2 OR sum(duration_ms) >= 2000 AS healthy FROM g GROUP BY ALL),
c AS (SELECT recording_id, label, list_transform(v, lambda x: x / n) AS centroid FROM (SELECT recording_id, label, list(s ORDER BY d) AS v, sqrt(sum(s * s)) AS n FROM (SELECT recording_id, label, d, sum(x) AS s FROM (SELECT recording_id, label, unnest(vector) AS x, generate_subscripts(vector, 1) AS d FROM g) GROUP BY ALL) GROUP BY ALL)),
m AS (SELECT recording_id, label, arg_min(l2, (dist, l2)) AS dest FROM (SELECT a.recording_id, a.label, b.label AS l2, 1 - list_dot_product(a.centroid, b.centroid) AS dist FROM c a JOIN h ha ON a.recording_id = ha.recording_id AND a.label = ha.label AND NOT ha.healthy JOIN c b ON a.recording_id = b.recording_id JOIN h hb ON b.recording_id = hb.recording_id AND b.label = hb.label AND hb.healthy) GROUP BY ALL),
f AS (SELECT g.recording_id, g.idx, coalesce(m.dest, g.label) AS label FROM g LEFT JOIN m ON g.recording_id = m.recording_id AND g.label = m.label)
SELECT recording_id, idx, CAST(dense_rank() OVER (PARTITION BY recording_id ORDER BY first) - 1 AS INTEGER) AS label FROM (SELECT *, min(idx) OVER (PARTITION BY recording_id, label) AS first FROM f)"""


@query("SELECT recording_id, round(max(p), 6) AS spread, max(p) <= 0.6 AS clear FROM (SELECT recording_id, label, list_sort(list(dist))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS p FROM (SELECT l.recording_id, l.label, 1 - list_dot_product(l.vector, c.centroid) AS dist FROM lab l JOIN cent c ON l.recording_id = c.recording_id AND l.label = c.label) GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL", "lab", "cent")
def clarity(spark, d):
    return tally.clarity(_labelled(spark, d)).withColumn("spread", F.round("spread", 6))


@query("SELECT recording_id, label, truth, count(*) AS samples, CAST(sum(duration_ms) AS BIGINT) AS ms FROM lab GROUP BY ALL", "lab")
def composition(spark, d):
    return _labelled(spark, d).groupBy("recording_id", "label", "truth").agg(F.count("*").alias("samples"), F.sum("duration_ms").alias("ms"))


@query("SELECT recording_id, label, second > 0.3 * (first + second) AS merged FROM (SELECT recording_id, label, max(ms) FILTER (r = 1) AS first, coalesce(max(ms) FILTER (r = 2), 0) AS second FROM (SELECT recording_id, label, truth, sum(duration_ms) AS ms, row_number() OVER (PARTITION BY recording_id, label ORDER BY sum(duration_ms) DESC, truth) AS r FROM lab WHERE label <> -1 GROUP BY recording_id, label, truth) GROUP BY ALL)", "lab")
def merged_groups(spark, d):
    own = _labelled(spark, d).where("label <> -1").groupBy("recording_id", "label", "truth").agg(F.sum("duration_ms").alias("ms"))
    top = own.groupBy("recording_id", "label").agg(F.slice(F.sort_array(F.collect_list("ms"), asc=False), 1, 2).alias("t"))
    second = F.coalesce(F.get("t", F.lit(1)), F.lit(0))
    return top.select("recording_id", "label", (second > 0.3 * (F.col("t")[0] + second)).alias("merged"))


@query("SELECT recording_id, idx, CASE WHEN duration_ms < 1500 THEN -1 ELSE label END AS label FROM lab", "lab")
def drop_short(spark, d):
    return _labelled(spark, d).select("recording_id", "idx", F.when(F.col("duration_ms") < 1500, -1).otherwise(F.col("label")).alias("label"))


@query("SELECT recording_id, idx, CASE WHEN list_sort(list(dist))[2] - list_sort(list(dist))[1] < 0.05 THEN -1 ELSE any_value(label) END AS label FROM (SELECT l.recording_id, l.idx, l.label, 1 - list_dot_product(l.vector, c.centroid) AS dist FROM lab l JOIN cent c USING (recording_id)) GROUP BY ALL", "lab", "cent")
def drop_ambiguous(spark, d):
    s = _labelled(spark, d)
    near = vectors.nearest(s, vectors.centroids(s.where("label <> -1"), ["recording_id", "label"]))
    return near.select("recording_id", "idx", F.when(F.col("margin") < 0.05, -1).otherwise(F.col("label")).alias("label"))


@query("SELECT recording_id, CAST(CASE WHEN duration_ms >= 6000 THEN 3 WHEN duration_ms >= 3000 THEN 2 WHEN duration_ms >= 1500 THEN 1 ELSE 0 END AS INTEGER) AS bucket, count(*) AS segments, count(*) FILTER (nearest <> label) AS misplaced FROM (SELECT recording_id, idx, duration_ms, label, arg_min(cl, (dist, cl)) AS nearest FROM (SELECT l.recording_id, l.idx, l.duration_ms, l.label, c.label AS cl, 1 - list_dot_product(l.vector, c.centroid) AS dist FROM lab l JOIN cent c USING (recording_id) WHERE l.label <> -1) GROUP BY ALL) GROUP BY ALL", "lab", "cent")
def misplaced_rate(spark, d):
    s = _labelled(spark, d).where("label <> -1")
    near = vectors.nearest(s, vectors.centroids(s, ["recording_id", "label"]))
    bucket = sum(((F.col("duration_ms") >= low).cast("int") for low in C.DURATION_BUCKETS_MS[1:]), F.lit(0))
    return near.groupBy("recording_id", bucket.alias("bucket")).agg(F.count("*").alias("segments"), F.count_if(F.col("nearest") != F.col("label")).alias("misplaced"))


@query("SELECT recording_id, people_s, truth, count(*) AS samples, CAST(sum(duration_ms) AS BIGINT) AS ms FROM (SELECT *, coalesce(sum(duration_ms) OVER (PARTITION BY recording_id, truth ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM samples), (SELECT unnest([5, 10, 15, 20]) AS people_s) WHERE before < people_s * 1000 GROUP BY ALL", "samples")
def enrol_cutoff(spark, d):
    before = F.coalesce(F.sum("duration_ms").over(Window.partitionBy("recording_id", "truth").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = tables.samples(spark, d).withColumn("_before", before).withColumn("people_s", F.explode(F.array(*(F.lit(n) for n in (5, 10, 15, 20)))))
    return each.where(F.col("_before") < F.col("people_s") * 1000).groupBy("recording_id", "people_s", "truth").agg(F.count("*").alias("samples"), F.sum("duration_ms").alias("ms"))


@query("SELECT recording_id, at_ms, kind FROM (SELECT user_id AS recording_id, event_id AS at_ms, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 4000")
def bounded_log(spark, d):
    e = tables.table(spark, d, "events").select(F.col("user_id").alias("recording_id"), F.col("event_id").alias("at_ms"), F.col("event_type").alias("kind"))
    last = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc("at_ms")))
    return e.withColumn("_r", last).where(F.col("_r") <= C.MAX_LOG).drop("_r")


@query("SELECT user_id AS recording_id, event_type AS kind, count(*) AS n, min(event_id) AS first_at FROM events GROUP BY ALL")
def log_summary(spark, d):
    e = tables.table(spark, d, "events").select(F.col("user_id").alias("recording_id"), F.col("event_id").alias("at_ms"), F.col("event_type").alias("kind"))
    return e.groupBy("recording_id", "kind").agg(F.count("*").alias("n"), F.min("at_ms").alias("first_at"))


# --- order-dependent: no SQL, held to exact cases by the tests ------------------------------------


@query()
def agglomerative_labels(spark, d):
    return cluster.agglomerative(vectors.centre(tables.samples(spark, d)), k=4)


@query()
def speaker_labels(spark, d):
    return cluster.label_speakers(tables.samples(spark, d), k=3)


@query()
def threshold_sweep(spark, d):
    return cluster.sweep(tables.samples(spark, d), (0.5, 0.6, 0.7, 0.8, 0.9, 1.0))


@query()
def tree_cuts(spark, d):
    """Groups of every recording at several counts and distances, all cut from one table of merges."""
    s = tables.samples(spark, d)
    cuts = spark.createDataFrame([("two", 2, None), ("three", 3, None), ("four", 4, None), ("near", None, 0.6), ("far", None, 0.9)], "cut string, k int, threshold double")
    return cluster.cut_trees(s, cluster.merge_trees(s), cuts)


@query()
def group_growth(spark, d):
    """How many voices distance alone finds as a recording goes on."""
    return cluster.growth(tables.samples(spark, d), C.GROWTH_MINUTES)


@query()
def carry_identities(spark, d):
    s = _labelled(spark, d).withColumn("previous", F.when(F.col("idx") % 50 < 40, (F.col("truth") + 1) % 4))
    return identity.carry_identities(s)


def _attributed(spark, d):
    s = tables.samples(spark, d).withColumn("enrolled", F.when(F.col("idx") % 50 < 12, (F.col("truth") % 4).cast("double")))
    return identity.attribute_profiles(s, "enrolled")


@query()
def profile_attribution(spark, d):
    return _attributed(spark, d).select("recording_id", "idx", "identity", _six("distance"))


_ATTRIBUTED = """fil AS (SELECT recording_id, CAST(truth % 4 AS BIGINT) AS p, d, sum(x * duration_ms) AS s FROM parts WHERE idx % 50 < 12 GROUP BY ALL),
prf AS (SELECT recording_id, list({'p': p, 'sums': sums} ORDER BY p) AS held FROM (SELECT recording_id, p, list(s ORDER BY d) AS sums FROM fil GROUP BY ALL) GROUP BY recording_id),
stp AS (SELECT recording_id, idx, vector, duration_ms, row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS i FROM samples WHERE idx % 50 >= 12),
rec AS (SELECT recording_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS idx, held, CAST(NULL AS BIGINT) AS identity, CAST(NULL AS DOUBLE) AS distance FROM prf
    UNION ALL SELECT recording_id, i, idx, list_transform(held, lambda h: {'p': h.p, 'sums': CASE WHEN h.p = hit.p AND hit.far <= 0.75 THEN list_transform(range(1, len(h.sums) + 1), lambda k: h.sums[k] + vector[k] * duration_ms) ELSE h.sums END}), hit.p, hit.far
    FROM (SELECT n.*, r.held, list_sort(list_transform(r.held, lambda h: {'far': 1 - list_dot_product(n.vector, h.sums) / sqrt(list_dot_product(h.sums, h.sums)), 'p': h.p}))[1] AS hit FROM rec r JOIN stp n ON n.recording_id = r.recording_id AND n.i = r.i + 1))
"""
ORACLE_SQL["profile_attribution"] = _recursive(_ATTRIBUTED + "SELECT recording_id, idx, identity, round(distance, 6) AS distance FROM rec WHERE i > 0", "samples", "parts")


@query()
def new_voice_runs(spark, d):
    times = tables.samples(spark, d).select("recording_id", "idx", "start_ms", "duration_ms")
    return identity.far_runs(_attributed(spark, d).join(times, ["recording_id", "idx"]))


ORACLE_SQL["new_voice_runs"] = _recursive(
    _ATTRIBUTED
    + f"""SELECT recording_id, arg_min(idx, (start_ms, idx)) AS idx, arg_min(from_ms, (start_ms, idx)) AS from_ms, arg_min(n, (start_ms, idx)) AS samples, arg_min(ms, (start_ms, idx)) AS ms
FROM (SELECT *, count(*) FILTER (pause) OVER (PARTITION BY recording_id ORDER BY start_ms, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stretch FROM (SELECT s.*, s.start_ms - lag(s.start_ms) OVER (PARTITION BY s.recording_id ORDER BY s.start_ms, s.idx) >= {C.QUIET_MS} AS pause,
min(s.start_ms) OVER w AS from_ms, count(*) OVER w AS n, CAST(sum(s.duration_ms) OVER w AS BIGINT) AS ms FROM samples s JOIN rec r ON s.recording_id = r.recording_id AND s.idx = r.idx WHERE r.distance > {C.FAR_DISTANCE} WINDOW w AS (PARTITION BY s.recording_id ORDER BY s.start_ms RANGE BETWEEN {C.FAR_WITHIN_MS} PRECEDING AND CURRENT ROW))) WHERE n >= {C.FAR_MIN_SAMPLES} AND ms >= {C.FAR_MIN_MS} GROUP BY recording_id, stretch""",
    "samples",
    "parts",
)


@query(
    """SELECT recording_id, arg_min(idx, (start_ms, idx)) AS idx, arg_min(from_ms, (start_ms, idx)) AS from_ms, arg_min(n, (start_ms, idx)) AS samples, arg_min(ms, (start_ms, idx)) AS ms
FROM (SELECT *, count(*) FILTER (pause) OVER (PARTITION BY recording_id ORDER BY start_ms, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stretch FROM (SELECT *, start_ms - lag(start_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, idx) >= 6000 AS pause,
min(start_ms) OVER w AS from_ms, count(*) OVER w AS n, CAST(sum(dur) OVER w AS BIGINT) AS ms FROM spans WHERE level > 20 WINDOW w AS (PARTITION BY recording_id ORDER BY start_ms RANGE BETWEEN 3000 PRECEDING AND CURRENT ROW))) WHERE n >= 3 AND ms >= 1500 GROUP BY recording_id, stretch""",
    "spans",
)
def loud_runs(spark, d):
    """The rule for new voices on another measure: spans above a level, three in three seconds, told of once until six seconds pass without one."""
    s = tables.spans(spark, d).select("recording_id", "idx", "start_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.col("level").alias("distance"))
    return identity.far_runs(s, identity.FarRule(20, 3, 1500, 3000, 6000))


@query()
def viterbi_smooth(spark, d):
    return cluster.viterbi(_labelled(spark, d), 0.3, 2000)


ORACLE_SQL["viterbi_smooth"] = _recursive(
    """seen AS (SELECT recording_id, label, row_number() OVER (PARTITION BY recording_id ORDER BY min(idx)) AS nth FROM lab WHERE label <> -1 GROUP BY recording_id, label),
cst AS (SELECT l.recording_id, l.idx, l.start_ms, l.end_ms, list(1 - list_dot_product(l.vector, c.centroid) ORDER BY nth) AS cost, list(s.label ORDER BY nth) AS names FROM lab l JOIN seen s ON l.recording_id = s.recording_id JOIN cent c ON c.recording_id = s.recording_id AND c.label = s.label GROUP BY l.recording_id, l.idx, l.start_ms, l.end_ms),
stp AS (SELECT *, range(1, len(cost) + 1) AS each, row_number() OVER w AS i, 0.3 * exp(-greatest(0, start_ms - lag(end_ms) OVER w) / 2000.0) AS cut FROM cst WINDOW w AS (PARTITION BY recording_id ORDER BY idx)),
rec AS (SELECT recording_id, i, cost AS total, list_transform(each, lambda s: [s]) AS path FROM stp WHERE i = 1
    UNION ALL SELECT recording_id, i, list_transform(each, lambda s: list_min(via[s]) + cost[s]), list_transform(each, lambda s: list_append(path[list_position(via[s], list_min(via[s]))], s))
    FROM (SELECT n.recording_id, n.i, n.each, n.cost, r.path, list_transform(n.each, lambda s: list_transform(n.each, lambda p: r.total[p] + CASE WHEN p = s THEN 0 ELSE n.cut END)) AS via FROM rec r JOIN stp n ON n.recording_id = r.recording_id AND n.i = r.i + 1)),
bst AS (SELECT recording_id, arg_max(path[list_position(total, list_min(total))], i) AS path FROM rec GROUP BY recording_id)
SELECT s.recording_id, s.idx, CAST(names[b.path[s.i]] AS BIGINT) AS label FROM stp s JOIN bst b ON s.recording_id = b.recording_id""",
    "lab",
    "cent",
)


@query()
def session_replay(spark, d):
    return identity.replay_sessions(tables.samples(spark, d), k=3).drop("identities")


@query()
def held_final_sets(spark, d):
    return identity.held_final_sets(tables.samples(spark, d), k=3)


@query("SELECT recording_id, idx, round(median(level) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS median FROM spans", "spans")
def running_median(spark, d):
    """The median level of all spans so far, as the loudness floor of a live session follows it."""
    return tally.running_median(tables.spans(spark, d), "level").select("recording_id", "idx", _six("median"))


@query("SELECT recording_id, idx, CASE WHEN idx % 3 = 0 THEN CASE n_sp WHEN 0 THEN 'quiet' WHEN 1 THEN 'one voice' ELSE 'several voices' END WHEN idx % 3 = 1 AND n_sp = 0 THEN 'still' WHEN n_sp = 0 THEN 'quiet' WHEN n_sp = 1 THEN 'one voice' ELSE 'several voices' END AS words FROM spans", "spans")
def translated_states(spark, d):
    """What is heard in words of a language, in English where the language lacks them."""
    s, texts = tables.spans(spark, d), {"en": {"0": "quiet", "1": "one voice", "2": "several voices"}, "xx": {"0": "still"}}
    key = F.least(F.size("speakers"), F.lit(2)).cast("string")
    language = F.when(F.col("idx") % 3 == 0, "en").when(F.col("idx") % 3 == 1, "xx").otherwise("none")
    return s.select("recording_id", "idx", scalars.translated(key, language, texts).alias("words"))


def _spoken(spark, d):
    """The conversations as sound to be made where it is heard: each turn said by its role's voice, a millisecond and a half a character."""
    from ..sources import audio

    return audio.scripted(tables.turns(spark, d), {"user": "A", "assistant": "B", "system": "C"}, 0.15)


@query()
def live_state(spark, d):
    """Every conversation played through a live session: the last state of each."""
    from ..streaming.live import replay_states

    return replay_states(_spoken(spark, d), speaker_count=2)


@query()
def diarize(spark, d):
    """The batch path from sound to shares, on every conversation."""
    from .diarize import diarize as run

    return run(_spoken(spark, d), speaker_count=2).shares


@query()
def session_export(spark, d):
    """Every recording of samples as one export document."""
    from ..sources import documents

    s = _labelled(spark, d).select("recording_id", "idx", F.col("start_ms").cast("double").alias("start_ms"), F.col("end_ms").cast("double").alias("end_ms"), F.col("duration_ms").cast("double").alias("duration_ms"), F.lit(0.0).alias("credited_ms"), F.lit(0.0).alias("level"), F.col("label").cast("int").alias("identity"), "vector")
    return documents.session_export(s, s.groupBy("recording_id").agg(F.max("end_ms").alias("elapsedMs"))).select("recording_id", "elapsedMs", F.array_join("identities", ",").alias("identities"), F.size("vectors").cast("long").alias("samples"))


ORACLE_SQL["session_export"] = sql("SELECT recording_id, CAST(max(end_ms) AS DOUBLE) AS elapsedMs, string_agg(CAST(label AS VARCHAR), ',' ORDER BY idx) AS identities, count(*) AS samples FROM lab GROUP BY ALL", "lab")


@query("SELECT recording_id, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS speakers, count(*) AS turns FROM trn GROUP BY ALL", "trn")
def truth_documents(spark, d):
    """Annotations as documents: speakers in order, and how many turns they hold."""
    from ..sources import documents

    return documents.truth_documents(tables.turns(spark, d)).select("recording_id", F.array_join("speakers", ",").alias("speakers"), F.size("turns").cast("long").alias("turns"))


# --- reports ------------------------------------------------------------------------------------

_ORACLE = """ctr AS (SELECT recording_id, truth, list_transform(v, lambda x: x / n) AS centroid FROM (SELECT recording_id, truth, list(s ORDER BY d) AS v, sqrt(sum(s * s)) AS n FROM (SELECT recording_id, truth, d, sum(x * duration_ms) AS s FROM parts GROUP BY ALL) GROUP BY ALL)),
jdg AS (SELECT recording_id, idx, duration_ms, own, nearest, own_distance, nearest <> own AS misplaced FROM (SELECT l.recording_id, l.idx, l.duration_ms, l.truth AS own, arg_min(c.truth, (1 - list_dot_product(l.vector, c.centroid), c.truth)) AS nearest, max(1 - list_dot_product(l.vector, c.centroid)) FILTER (c.truth = l.truth) AS own_distance FROM samples l JOIN ctr c USING (recording_id) GROUP BY ALL))"""


@query()
def oracle_assignment(spark, d):
    return reports.oracle_labels(tables.samples(spark, d)).withColumn("own_distance", F.round("own_distance", 6))


ORACLE_SQL["oracle_assignment"] = sql("", "parts").rstrip() + ",\n" + _ORACLE + "\nSELECT recording_id, idx, duration_ms, own, nearest, round(own_distance, 6) AS own_distance, misplaced FROM jdg"


@query()
def placement_medians(spark, d):
    return reports.placement_medians(reports.oracle_labels(tables.samples(spark, d))).withColumn("own_distance", F.round("own_distance", 6))


_UPPER = lambda x: f"list_sort(list({x}))[CAST(least(floor(0.5 * count(*)), count(*) - 1) AS BIGINT) + 1]"
ORACLE_SQL["placement_medians"] = sql("", "parts").rstrip() + ",\n" + _ORACLE + f"\nSELECT recording_id, own, misplaced, count(*) AS segments, {_UPPER('duration_ms')} AS duration_ms, round({_UPPER('own_distance')}, 6) AS own_distance FROM jdg GROUP BY ALL"


@query("SELECT h.recording_id, h.idx, round(coalesce(sum(ms) FILTER (h.speaker = s2), 0) / any_value(h.dur), 6) AS purity, round(coalesce(sum(ms) FILTER (h.speaker <> s2), 0) / any_value(h.dur), 6) AS others, round(greatest(0.0, 1 - coalesce(sum(ms), 0) / any_value(h.dur)), 6) AS unannotated FROM hyp h LEFT JOIN (SELECT h.recording_id, h.idx, t.speaker AS s2, least(h.end_ms, t.end_ms) - greatest(h.start_ms, t.start_ms) AS ms FROM hyp h JOIN trn t ON h.recording_id = t.recording_id AND t.start_ms < h.end_ms AND t.end_ms > h.start_ms) m ON h.recording_id = m.recording_id AND h.idx = m.idx WHERE h.dur > 0 GROUP BY h.recording_id, h.idx", "hyp")
def segment_purity(spark, d):
    found = reports.purity(tables.hypothesis(spark, d), tables.turns(spark, d))
    return found.select("recording_id", "idx", _six("purity"), _six("others"), _six("unannotated"))


@query("SELECT recording_id, idx, (pmod1 < 60 OR pmod1 > 4940) OR (pmod2 < 60 OR pmod2 > 4940) AS on_boundary FROM (SELECT recording_id, idx, ((start_ms - 2500) % 5000 + 5000) % 5000 AS pmod1, ((end_ms - 2500) % 5000 + 5000) % 5000 AS pmod2 FROM usable)", "usable")
def boundary_spans(spark, d):
    return _usable(spark, d).select("recording_id", "idx", (scalars.on_boundary(F.col("start_ms")) | scalars.on_boundary(F.col("end_ms"))).alias("on_boundary"))


@query(
    """SELECT recording_id, label, count(*) AS samples, count(*) FILTER (duration_ms < 1500) AS short, round(list_sort(list(d))[CAST(least(floor(0.5 * count(*)), count(*) - 1) AS BIGINT) + 1], 6) AS p50, round(list_sort(list(d))[CAST(least(floor(0.9 * count(*)), count(*) - 1) AS BIGINT) + 1], 6) AS p90, count(*) FILTER (nearest <> label AND least_d < d) AS closer
FROM (SELECT v.recording_id, v.idx, v.duration_ms, v.label, max(1 - list_dot_product(v.vector, c.centroid)) FILTER (c.label = v.label) AS d, arg_min(c.label, (1 - list_dot_product(v.vector, c.centroid), c.label)) AS nearest, min(1 - list_dot_product(v.vector, c.centroid)) AS least_d FROM cvec v JOIN ccen c USING (recording_id) WHERE v.label <> -1 GROUP BY ALL) GROUP BY recording_id, label""",
    "cvec",
    "ccen",
)
def spread_by_person(spark, d):
    found = reports.spread_by_person(_labelled(spark, d))
    return found.select("recording_id", "label", "samples", "short", _six("p50"), _six("p90"), "closer")


@query()
def policy_scoreboard(spark, d):
    return reports.scoreboard(tables.samples(spark, d), k=4)


@query()
def enrolment_report(spark, d):
    return reports.enrolment_report(tables.samples(spark, d))


@query()
def newcomer_report(spark, d):
    return reports.newcomer_report(tables.samples(spark, d))


@query()
def smoothing_report(spark, d):
    return reports.smoothing_report(tables.samples(spark, d), k=4)


@query()
def field_report(spark, d):
    return reports.field_report(tables.samples(spark, d), k=4)


def _diagnosis(spark, d):
    """The samples as segments of whom the turns about them say, with a level."""
    s, t = tables.samples(spark, d).drop("truth"), tables.sample_turns(spark, d)
    named = s.join(interval.majority_speaker(s.select("recording_id", "idx", "start_ms", "end_ms"), t), ["recording_id", "idx"])
    return segments.diagnose(named.withColumn("level", F.col("idx") * 29 % 997 / 10_000), t)


_DIAGNOSIS = """ann AS (SELECT recording_id, idx * 2 AS idx, CAST(truth AS VARCHAR) AS speaker, start_ms - 400 + idx * 53 % 900 AS start_ms, greatest(end_ms - idx * 29 % 1500, start_ms - 300 + idx * 53 % 900) AS end_ms FROM samples
    UNION ALL SELECT recording_id, idx * 2 + 1, CAST((truth + 1) % 4 AS VARCHAR), start_ms + duration_ms // 2, start_ms + duration_ms // 2 + duration_ms // 3 FROM samples WHERE idx % 4 = 1),
shr AS (SELECT s.recording_id, s.idx, s.duration_ms AS dur, t.speaker, CAST(sum(least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms)) AS BIGINT) AS ms, min(t.idx) AS f FROM samples s JOIN ann t ON s.recording_id = t.recording_id AND t.start_ms < s.end_ms AND t.end_ms > s.start_ms GROUP BY ALL),
rnk AS (SELECT *, row_number() OVER (PARTITION BY recording_id, idx ORDER BY ms DESC, f) AS r FROM shr),
own AS (SELECT s.recording_id, s.idx, CASE WHEN b.ms > 0.25 * s.duration_ms THEN 'mixed' WHEN a.ms > 0.5 * s.duration_ms THEN a.speaker ELSE '?' END AS own FROM samples s LEFT JOIN rnk a ON s.recording_id = a.recording_id AND s.idx = a.idx AND a.r = 1 LEFT JOIN rnk b ON s.recording_id = b.recording_id AND s.idx = b.idx AND b.r = 2),
cvo AS (SELECT v.recording_id, v.idx, v.duration_ms, v.vector, o.own FROM cvec v JOIN own o ON v.recording_id = o.recording_id AND v.idx = o.idx WHERE o.own NOT IN ('?', 'mixed')),
cto AS (SELECT recording_id, own, list_transform(v, lambda x: x / n) AS centroid FROM (SELECT recording_id, own, list(s ORDER BY d) AS v, sqrt(sum(s * s)) AS n FROM (SELECT recording_id, own, d, sum(x * duration_ms) AS s FROM (SELECT recording_id, own, duration_ms, unnest(vector) AS x, generate_subscripts(vector, 1) AS d FROM cvo) GROUP BY ALL) GROUP BY ALL)),
far AS (SELECT v.recording_id, v.idx, v.own, v.duration_ms, arg_min(c.own, (1 - list_dot_product(v.vector, c.centroid), c.own)) AS nearest, max(1 - list_dot_product(v.vector, c.centroid)) FILTER (c.own = v.own) AS own_distance FROM cvo v JOIN cto c USING (recording_id) GROUP BY v.recording_id, v.idx, v.own, v.duration_ms),
cov AS (SELECT r.recording_id, r.idx, sum(ms) FILTER (speaker = own) AS mine, sum(ms) FILTER (speaker <> own) AS theirs FROM shr r JOIN own USING (recording_id, idx) GROUP BY ALL),
dia AS (SELECT f.recording_id, f.idx, f.own, CAST(f.idx * 5000 // 60000 AS INTEGER) AS minute, nearest <> f.own AS misplaced, nearest, CAST(f.duration_ms AS BIGINT) AS duration_ms, coalesce(mine, 0) / f.duration_ms AS purity, coalesce(theirs, 0) / f.duration_ms AS others,
    greatest(0.0, 1 - (coalesce(mine, 0) + coalesce(theirs, 0)) / f.duration_ms) AS unannotated, f.idx * 29 % 997 / 10000 AS level, own_distance FROM far f LEFT JOIN cov c ON f.recording_id = c.recording_id AND f.idx = c.idx)
"""


@query()
def segment_diagnosis(spark, d):
    """Each segment of one speaker: how pure, how loud, how far from its speaker, and who is nearest."""
    return _diagnosis(spark, d).select("recording_id", "idx", "own", "minute", "misplaced", "nearest", "duration_ms", *map(_six, segments.FEATURES[1:]))


@query()
def segment_contrast(spark, d):
    """Medians of misplaced and of well-placed segments by speaker."""
    found = segments.contrast(_diagnosis(spark, d))
    return found.select(*(_six(c) if c.startswith(segments.FEATURES[1:]) else c for c in found.columns))


@query()
def segments_drawn_to(spark, d):
    """Whom misplaced segments are nearest to, and in which minutes; the list as text."""
    return segments.drawn_to(_diagnosis(spark, d)).withColumn("minutes", F.array_join("minutes", ","))


@query()
def misplaced_by_bin(spark, d):
    """How many segments are misplaced by purity and by duration."""
    return segments.rates(_diagnosis(spark, d))


_HEAD = sql("", "samples", "cvec").rstrip() + ",\n" + _DIAGNOSIS
_MEDIANS = ", ".join(
    f"round(list_sort(list({f}) FILTER ({on}))[CAST(least(floor(0.5 * count({f}) FILTER ({on})), count({f}) FILTER ({on}) - 1) AS BIGINT) + 1], 6) AS {f}_{side}" for f in segments.FEATURES for side, on in (("misplaced", "misplaced"), ("placed", "NOT misplaced"))
)
ORACLE_SQL["segment_diagnosis"] = _HEAD + "SELECT recording_id, idx, own, minute, misplaced, nearest, duration_ms, round(purity, 6) AS purity, round(others, 6) AS others, round(unannotated, 6) AS unannotated, round(level, 6) AS level, round(own_distance, 6) AS own_distance FROM dia"
ORACLE_SQL["segment_contrast"] = _HEAD + f"SELECT recording_id, own, count(*) AS segments, count(*) FILTER (misplaced) AS misplaced, count(*) FILTER (misplaced AND others > 0) AS crowded_misplaced, count(*) FILTER (NOT misplaced AND others > 0) AS crowded_placed, {_MEDIANS} FROM dia GROUP BY ALL"
ORACLE_SQL["segments_drawn_to"] = _HEAD + "SELECT recording_id, own, nearest, count(*) AS segments, string_agg(minute, ',' ORDER BY minute) AS minutes FROM dia WHERE misplaced GROUP BY ALL"
ORACLE_SQL["misplaced_by_bin"] = _HEAD + """SELECT recording_id, measure, least, count(*) AS segments, count(*) FILTER (misplaced) AS misplaced FROM (SELECT recording_id, misplaced, 'purity' AS measure, CASE WHEN purity >= 0.95 THEN 0.95 WHEN purity >= 0.75 THEN 0.75 WHEN purity >= 0.5 THEN 0.5 ELSE 0 END::DOUBLE AS least FROM dia
UNION ALL SELECT recording_id, misplaced, 'duration_ms', CASE WHEN duration_ms >= 6000 THEN 6000 WHEN duration_ms >= 3000 THEN 3000 WHEN duration_ms >= 1500 THEN 1500 ELSE 0 END::DOUBLE FROM dia) GROUP BY ALL"""


@query("SELECT a.recording_id, a.label AS a, b.label AS b, round(1 - list_dot_product(a.centroid, b.centroid), 6) AS distance FROM ccen a JOIN ccen b ON a.recording_id = b.recording_id AND a.label < b.label", "ccen")
def people_distances(spark, d):
    """How far the people of each recording are from each other."""
    return field.people_distances(_labelled(spark, d)).withColumn("distance", F.round("distance", 6))


@query()
def head_count_alternatives(spark, d):
    """What groups would consist of with one person fewer and one more."""
    return field.alternatives(_labelled(spark, d), k=4)


@query("SELECT user_id AS recording_id, event_type AS kind, count(*) AS entries, min(event_id // 10) AS first_at_ms, arg_min(props, (event_id // 10, props)) AS first_detail FROM events GROUP BY ALL")
def log_report(spark, d):
    """Events as a session's log: how many of each kind, and the first one's words."""
    e = tables.table(spark, d, "events")
    return field.log_report(e.select(F.col("user_id").alias("recording_id"), F.col("event_type").alias("kind"), F.floor(F.col("event_id") / 10).alias("at_ms"), F.col("props").alias("detail")))


@query()
def first_appearances(spark, d):
    """When the replayed page first showed each identity."""
    return field.appearances(tables.samples(spark, d), k=3)


# --- small rules ----------------------------------------------------------------------------------


@query(
    "SELECT recording_id, idx, CAST(greatest(0, ceil((end_ms - 7500) / 5000)) AS INTEGER) AS window_no, floor(level / 7 * 10000 + 0.5) / 10000 AS rounded, least(1.0, level / 1000 * 4) AS input_level, end_ms - start_ms > 3000 AS late, idx % 8 AS colour, CAST(floor(start_ms / 1000 * 16000 + 0.5) AS BIGINT) AS first_sample FROM usable",
    "usable",
)
def scalar_rules(spark, d):
    u, level = _usable(spark, d), F.col("level")
    return u.select("recording_id", "idx", scalars.window_number(F.col("end_ms")).alias("window_no"), scalars.rounded4(level / 7).alias("rounded"), scalars.input_level(level / 1000).alias("input_level"), scalars.stalled(F.lit(True), F.col("end_ms") * 10, F.col("start_ms") * 10).alias("late"), scalars.palette(F.col("idx")).alias("colour"), scalars.ms_to_sample(F.col("start_ms")).alias("first_sample"))


@query("SELECT recording_id, count(*) AS samples, CAST(least(8, floor(count(*) / 25)) AS INTEGER) AS headroom, count(DISTINCT truth) >= 4 AS large_table FROM samples GROUP BY ALL", "samples")
def headroom(spark, d):
    counts = tables.samples(spark, d).groupBy("recording_id").agg(F.count("*").alias("samples"), F.count_distinct("truth").alias("people"))
    return counts.select("recording_id", "samples", scalars.splinter_headroom(F.col("samples")).alias("headroom"), scalars.large_table_hint(F.col("people"), F.lit(False)).alias("large_table"))


@query(
    "SELECT h.recording_id, h.idx, coalesce(min(t.idx), -1) AS period FROM (SELECT recording_id, idx, (start_ms + end_ms) / 2 AS mid FROM hyp) h LEFT JOIN trn t ON h.recording_id = t.recording_id AND t.idx % 2 = 0 AND t.start_ms <= h.mid AND h.mid < t.end_ms GROUP BY ALL",
    "hyp",
)
def period_routing(spark, d):
    """Every other turn as an introduction period, and the period that holds each span's middle."""
    periods = tables.turns(spark, d).where(F.col("idx") % 2 == 0).select("recording_id", F.col("idx").alias("period"), F.col("start_ms").cast("double").alias("from_ms"), F.col("end_ms").cast("double").alias("to_ms"))
    middles = tables.hypothesis(spark, d).select("recording_id", "idx", ((F.col("start_ms") + F.col("end_ms")) / 2).alias("mid_ms"))
    return interval.period_of(middles, periods).select("recording_id", "idx", F.coalesce("period", F.lit(-1)).alias("period"))


@query("SELECT c.recording_id, c.label AS speaker, coalesce(n.name, 'Speaker ' || (c.label + 1)) AS name, CAST(sum(dur + credited_ms) AS BIGINT) AS total_ms FROM credited c LEFT JOIN (VALUES (0, 'Ilse'), (2, 'Noor')) n(id, name) ON c.label = n.id GROUP BY ALL", "credited")
def named_legend(spark, d):
    """Typed names by number, or 'Speaker n' for who has none."""
    names = spark.createDataFrame([(0, "Ilse"), (2, "Noor")], "speaker int, name string")
    named = tally.shares(_credited(spark, d)).join(names, "speaker", "left")
    return named.select("recording_id", "speaker", F.coalesce("name", F.concat(F.lit("Speaker "), F.col("speaker") + 1)).alias("name"), "total_ms")


@query("SELECT recording_id, idx FROM (SELECT *, coalesce(sum(duration_ms) OVER (PARTITION BY recording_id, truth ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM samples) WHERE before >= 10000", "samples")
def not_enrolled(spark, d):
    """Samples that are no part of their speaker's first ten seconds."""
    s = tables.samples(spark, d)
    before = F.coalesce(F.sum("duration_ms").over(Window.partitionBy("recording_id", "truth").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    enrolled = s.withColumn("_before", before).where("_before < 10000").select("recording_id", "idx")
    return s.select("recording_id", "idx").join(enrolled, ["recording_id", "idx"], "left_anti")
