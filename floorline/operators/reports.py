"""Reports that compare policies: each recording with its annotation under every variant, a scenario at a time."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import constants as C
from ..functions.vectors import cosine_distance, nearest_rank
from . import cluster as c
from .identity import FarRule, FarStretch, Profile, attribute, carry, nearest_profile, replay
from .interval import overlap_join
from .vectors import centre, centroids, nearest

UNKNOWN = ("?", "mixed")


def shipped(v: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """The policy for a known head count, on centred vectors: cut wide, keep the busiest, place the rest."""
    room = min(C.SPLINTER_MOST, len(v) // C.SPLINTER_EVERY)
    return c.placed(v, c.busiest(c.average_linkage(v, k=k + room), w, k), w)


def core_first(v: np.ndarray, w: np.ndarray, k: int, least_ms: float) -> np.ndarray:
    """Groups of the longer segments alone; the shorter go to the nearest. Too few longer ones: all are grouped."""
    core = w >= least_ms
    if core.sum() < k:
        return c.busiest(c.average_linkage(v, k=k), w, k)
    labels = np.full(len(v), C.OTHER_VOICE)
    labels[core] = c.average_linkage(v[core], k=k)
    return c.placed(v, labels, w)


def keep_and_place(v: np.ndarray, w: np.ndarray, k: int, extra: int) -> np.ndarray:
    return c.placed(v, c.busiest(c.average_linkage(v, k=min(k + extra, len(v))), w, k), w)


def without_ambiguous(v: np.ndarray, w: np.ndarray, labels: np.ndarray, margin: float) -> np.ndarray:
    """Labels of samples whose nearest centroid isn't ahead by ``margin`` become -1."""
    _, centres = c.group_centroids(v, labels, w)
    if len(centres) < 2:
        return labels
    far = np.sort(1.0 - v @ centres.T, axis=1)
    return np.where(far[:, 1] - far[:, 0] < margin, C.OTHER_VOICE, labels)


#: The policies of the scoreboard, on centred vectors.
POLICIES: dict[str, Callable[[np.ndarray, np.ndarray, int], np.ndarray]] = {
    "shipped": shipped,
    "cut at k": lambda v, w, k: c.average_linkage(v, k=k),
    "core 1.5 s": lambda v, w, k: core_first(v, w, k, 1500),
    "core 2 s": lambda v, w, k: core_first(v, w, k, 2000),
    "core 3 s": lambda v, w, k: core_first(v, w, k, 3000),
    "extra 4": lambda v, w, k: keep_and_place(v, w, k, 4),
    "extra 8": lambda v, w, k: keep_and_place(v, w, k, 8),
    "drop short": lambda v, w, k: np.where(w < 1500, C.OTHER_VOICE, shipped(v, w, k)),
    "drop ambiguous": lambda v, w, k: without_ambiguous(v, w, shipped(v, w, k), 0.05),
}


def best_names(labels: np.ndarray, truth: np.ndarray, w: np.ndarray) -> dict[int, str]:
    """Labels to annotated speakers by shared speech, the largest first, each side once."""
    known = ~np.isin(truth, UNKNOWN) & (labels != C.OTHER_VOICE)
    shared = pd.Series(w[known]).groupby([labels[known], truth[known]]).sum().sort_values(ascending=False, kind="stable")
    out: dict[int, str] = {}
    for label, name in shared.index:
        if label not in out and name not in out.values():
            out[label] = name
    return out


def accuracy(labels: np.ndarray, truth: np.ndarray, w: np.ndarray, names: dict[int, str], only: np.ndarray | None = None) -> float:
    """Share of known speech under the right name; 0 if there is none."""
    on = ~np.isin(truth, UNKNOWN) if only is None else ~np.isin(truth, UNKNOWN) & only
    right = np.array([names.get(int(l)) == t for l, t in zip(labels, truth, strict=True)], dtype=bool)
    return float(w[on & right].sum() / w[on].sum()) if w[on].sum() > 0 else 0.0


def enrolled_first(truth: np.ndarray, w: np.ndarray, seconds: float) -> np.ndarray:
    """Which samples introduce their speaker: those heard before the speaker had ``seconds``."""
    got: dict[str, float] = {}
    out = np.zeros(len(truth), dtype=bool)
    for i, (t, ms) in enumerate(zip(truth, w, strict=True)):
        if t not in UNKNOWN and got.get(t, 0.0) < seconds * 1000:
            out[i], got[t] = True, got.get(t, 0.0) + ms
    return out


def _profiles(v: np.ndarray, w: np.ndarray, truth: np.ndarray, on: np.ndarray, people: list) -> list[Profile]:
    out = []
    for p in people:
        profile = Profile()
        for i in np.flatnonzero(on & (truth == p)):
            profile.add(v[i], w[i])
        out.append(profile)
    return out


def enrolment(v: np.ndarray, starts: np.ndarray, w: np.ndarray, truth: np.ndarray) -> list[tuple[int, str, str, float]]:
    """(seconds, space, mode, accuracy on the rest) for introductions of several lengths and ways of learning."""
    people = list(dict.fromkeys(t for t in truth if t not in UNKNOWN))
    names, out = dict(enumerate(people)), []
    spaces = {"raw": v, "centred": c.centred(v)}
    for seconds, space, mode in product((5, 10, 15, 20), spaces, ("fixed", "online", "gated", "online+sweep")):
        x, on = spaces[space], enrolled_first(truth, w, seconds)
        profiles = _profiles(x, w, truth, on, people)
        labels = np.array([people.index(t) if e else C.OTHER_VOICE for t, e in zip(truth, on, strict=True)])
        for i in np.flatnonzero(~on):
            hit = nearest_profile(x[i], profiles)
            if hit is None:
                continue
            labels[i] = hit[0]
            if mode.startswith("online") or mode == "gated" and hit[1] <= C.LEARN_DISTANCE:
                profiles[hit[0]].add(x[i], w[i])
        if mode == "online+sweep":
            for i in np.flatnonzero(~on):
                labels[i] = nearest_profile(x[i], profiles)[0]
        out.append((seconds, space, mode, accuracy(labels, truth, w, names, ~on)))
    return out


#: Rules tried for noticing a newcomer, as (far, samples, ms).
NEWCOMER_RULES = ((0.75, 3, 4_000.0), (0.8, 3, 4_000.0), (0.75, 4, 6_000.0))


def newcomers(v: np.ndarray, starts: np.ndarray, w: np.ndarray, truth: np.ndarray, end_ms: float) -> list[tuple]:
    """(learn, far, samples, ms, people, detected, first latency, false suggestions, hours): each person hidden in turn."""
    people, out = list(dict.fromkeys(t for t in truth if t not in UNKNOWN)), []
    for learn, (far, samples, ms) in product(("all", "near"), NEWCOMER_RULES):
        detected, wrong, latencies = 0, 0, []
        for hidden in people:
            on = enrolled_first(truth, w, 10) & (truth != hidden)
            rest, found = np.flatnonzero(~on), False
            hits = attribute(v[rest], w[rest], _profiles(v, w, truth, on, [p for p in people if p != hidden]), within=np.inf if learn == "all" else far)
            own = {float(starts[i]): truth[i] == hidden for i in rest}
            first = min((starts[i] for i in rest if truth[i] == hidden), default=np.inf)
            stretch = FarStretch(FarRule(far, samples, ms))
            for i in (i for i, hit in zip(rest, hits, strict=True) if hit[1] > far):
                if run := stretch.hear(float(starts[i]), float(w[i])):
                    share = sum(m for at, m in run if own[at]) / sum(m for _, m in run)
                    if share < 0.5:
                        wrong += 1
                    elif not found:
                        found = True
                        latencies.append(float(starts[i] - first) / 1000)
            detected += found
        out.append((learn, far, samples, ms, len(people), detected, min(latencies, default=None), wrong, len(people) * end_ms / 3_600_000))
    return out


def _each(samples: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on each recording in idx order: a list of rows, which get the recording's id in front."""
    kind = samples.schema["recording_id"].dataType.simpleString()
    names = ["recording_id", *(part.strip().split(" ")[0] for part in schema.split(","))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx").reset_index(drop=True)
        return pd.DataFrame([(pdf["recording_id"].iloc[0], *row) for row in work(pdf)], columns=names)

    columns = ["recording_id", "idx", "vector", "start_ms", "end_ms", "duration_ms", F.col("truth").cast("string").alias("truth")]
    return samples.select(*columns).groupBy("recording_id").applyInPandas(run, f"recording_id {kind}, {schema}")


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.stack(pdf["vector"].to_numpy()).astype(np.float64), pdf["start_ms"].to_numpy(np.float64), pdf["duration_ms"].to_numpy(np.float64), pdf["truth"].to_numpy(object)


def scoreboard(samples: DataFrame, k: int) -> DataFrame:
    """(recording_id, policy, groups, unattributed_ms, accuracy) for every policy."""

    def work(pdf):
        v, _, w, truth = _arrays(pdf)
        v = c.centred(v)
        for name, policy in POLICIES.items():
            labels = policy(v, w, k)
            yield name, len(set(labels) - {C.OTHER_VOICE}), float(w[labels == C.OTHER_VOICE].sum()), round(accuracy(labels, truth, w, best_names(labels, truth, w)), 6)

    return _each(samples, work, "policy string, groups int, unattributed_ms double, accuracy double")


def enrolment_report(samples: DataFrame) -> DataFrame:
    """(recording_id, seconds, space, mode, accuracy)."""
    return _each(samples, lambda pdf: [(s, sp, m, round(a, 6)) for s, sp, m, a in enrolment(*_arrays(pdf))], "seconds int, space string, mode string, accuracy double")


def newcomer_report(samples: DataFrame) -> DataFrame:
    schema = "learn string, far double, samples int, ms double, people int, detected int, latency_s double, false_suggestions int, hours double"
    return _each(samples, lambda pdf: newcomers(*_arrays(pdf), float(pdf["end_ms"].iloc[-1])), schema)


def smoothing_report(samples: DataFrame, k: int) -> DataFrame:
    """(recording_id, penalty, tau_ms, changed, accuracy) over the grid of penalties and time constants."""

    def work(pdf):
        v, starts, w, truth = _arrays(pdf)
        v, ends = c.centred(v), pdf["end_ms"].to_numpy(np.float64)
        base = shipped(v, w, k)
        for penalty, tau in C.SMOOTHING_GRID:
            labels = c.smoothed_labels(v, base, w, starts, ends, penalty, tau)
            yield penalty, tau, int((labels != base).sum()), round(accuracy(labels, truth, w, best_names(labels, truth, w)), 6)

    return _each(samples, work, "penalty double, tau_ms int, changed int, accuracy double")


def field_report(samples: DataFrame, k: int) -> DataFrame:
    """(recording_id, samples, agree, replay_agree, relabelled, identities): an export's labels (``truth``) grouped anew and replayed."""

    def work(pdf):
        v, _, w, truth = _arrays(pdf)
        names = {t: i for i, t in enumerate(dict.fromkeys(truth))}
        shown = [names[t] for t in truth]
        again, _ = carry(shipped(c.centred(v), w, k).tolist(), shown, w.tolist(), len(names))
        steps = replay(v, pdf["end_ms"].to_numpy(np.float64), w, k)
        yield len(v), sum(a == b for a, b in zip(again, shown, strict=True)), sum(a == b for a, b in zip(steps[-1][1], shown, strict=True)), sum(s[2] for s in steps), len({i for s in steps for i in s[1]})

    return _each(samples, work, "samples int, agree int, replay_agree int, relabelled int, identities int")


def oracle_labels(samples: DataFrame) -> DataFrame:
    """(recording_id, idx, own, nearest, own_distance, misplaced): each sample against the annotated speakers' centroids."""
    centres = centroids(samples, ["recording_id", "truth"])
    near = nearest(samples, centres, "truth").join(centres, ["recording_id", "truth"])
    return near.select("recording_id", "idx", "duration_ms", F.col("truth").alias("own"), "nearest", cosine_distance(F.col("vector"), F.col("centroid")).alias("own_distance"), (F.col("nearest") != F.col("truth")).alias("misplaced"))


def placement_medians(judged: DataFrame) -> DataFrame:
    """(recording_id, own, misplaced, segments, duration_ms, own_distance): upper medians of the misplaced and the others."""
    lists = judged.groupBy("recording_id", "own", "misplaced").agg(F.count("*").alias("segments"), F.collect_list("duration_ms").alias("_a"), F.collect_list("own_distance").alias("_b"))
    return lists.select("recording_id", "own", "misplaced", "segments", nearest_rank(F.col("_a"), 0.5).alias("duration_ms"), nearest_rank(F.col("_b"), 0.5).alias("own_distance"))


def purity(spans: DataFrame, turns: DataFrame) -> DataFrame:
    """(recording_id, idx, purity, others, unannotated): how much of a span is its ``speaker``'s, others' and nobody's."""
    length = F.col("end_ms") - F.col("start_ms")
    own = F.col("b_speaker") == F.col("speaker")
    met = overlap_join(spans, turns).groupBy("recording_id", "idx").agg(F.sum(F.when(own, F.col("shared_ms")).otherwise(0)).alias("_own"), F.sum(F.when(own, 0).otherwise(F.col("shared_ms"))).alias("_others"))
    some = spans.where(length > 0).join(met, ["recording_id", "idx"], "left").withColumns({"_own": F.coalesce("_own", F.lit(0)), "_others": F.coalesce("_others", F.lit(0))})
    return some.select("recording_id", "idx", (F.col("_own") / length).alias("purity"), (F.col("_others") / length).alias("others"), F.greatest(F.lit(0.0), 1 - (F.col("_own") + F.col("_others")) / length).alias("unannotated"))


def spread_by_person(labelled: DataFrame) -> DataFrame:
    """(recording_id, label, samples, short, p50, p90, closer): spread around one's own centroid, in centred space."""
    own = centre(labelled).where(F.col("label") != C.OTHER_VOICE)
    centres = centroids(own, ["recording_id", "label"])
    near = nearest(own, centres).join(centres, ["recording_id", "label"]).withColumn("d", cosine_distance(F.col("vector"), F.col("centroid")))
    lists = near.groupBy("recording_id", "label").agg(F.count("*").alias("samples"), F.count_if(F.col("duration_ms") < 1500).alias("short"), F.collect_list("d").alias("ds"), F.count_if((F.col("nearest") != F.col("label")) & (F.col("distance") < F.col("d"))).alias("closer"))
    return lists.select("recording_id", "label", "samples", "short", nearest_rank(F.col("ds"), 0.5).alias("p50"), nearest_rank(F.col("ds"), 0.9).alias("p90"), "closer")

