"""Grouping voice samples: average linkage where order matters, DataFrame operators for all around it."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import constants as C
from . import spread
from .vectors import centroids, nearest


# --- on arrays, for one recording -------------------------------------------------------------


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at unit length; zero rows as they are."""
    v = np.asarray(v, dtype=np.float64)
    length = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return np.divide(v, length, out=v.copy(), where=length > 0)


def centred(v: np.ndarray, least: int = C.MIN_FOR_CENTRING) -> np.ndarray:
    v = np.asarray(v, dtype=np.float64)
    return v if len(v) < least else unit(v - v.mean(axis=0))


def renumbered(labels: np.ndarray) -> np.ndarray:
    """Labels 0, 1, ... in order of first appearance."""
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


class Tree(NamedTuple):
    """Merges in the order in which they were made: at step s the group ``right[s]`` goes into ``left[s]``, at ``height[s]``.

    A group is named by its first sample, so ``left[s] < right[s]``, and each name is a ``right`` once at most.
    """

    samples: int
    left: np.ndarray
    right: np.ndarray
    height: np.ndarray

    def steps(self, k: int | None = None, threshold: float | None = None) -> int:
        """How many merges leave ``k`` groups, or, without ``k``, come before the first one above ``threshold``."""
        if k is not None:
            return min(len(self.height), self.samples - min(max(int(k), 1), self.samples))
        over = np.flatnonzero(self.height > (np.inf if threshold is None else threshold))
        return int(over[0]) if len(over) else len(self.height)

    def cut(self, k: int | None = None, threshold: float | None = None) -> np.ndarray:
        """Labels by first appearance after so many merges; without a count or a threshold after all of them."""
        n = self.steps(k, threshold)
        owner = np.arange(self.samples)
        owner[self.right[:n]] = self.left[:n]
        for i in range(self.samples):  # what a group went into has a lower name, and so its own owner by now
            owner[i] = owner[owner[i]]
        return renumbered(owner)


def merge_tree(vectors: np.ndarray, k: int | None = None, threshold: float | None = None) -> Tree:
    """The closest two groups merge, ties to the lowest numbers, until ``k`` are left or, without it, none is within ``threshold``.

    Distances are float32 and a merged group's distance is the mean by size. Each row remembers its nearest later group; after
    a merge only rows that had one of the two look again, so a merge mostly costs as much as there are groups.
    """
    n = len(vectors)
    merges: list[tuple[int, int, float]] = []
    goal = 1 if k is None else min(max(int(k), 1), n)
    stop = np.inf if k is not None or threshold is None else threshold
    if n > 1:
        x = np.asarray(vectors, dtype=np.float64)
        d = (1.0 - x @ x.T).astype(np.float32)
        d[np.tril_indices(n)] = np.inf  # row i holds its distances to later groups
        size, alive = np.ones(n), np.ones(n, dtype=bool)
        near = d.argmin(axis=1)
        best = d[np.arange(n), near]
    while len(merges) < n - goal:
        i = int(np.argmin(best))
        if best[i] > stop or not np.isfinite(best[i]):
            break
        j = int(near[i])
        merges.append((i, j, float(best[i])))
        others = np.flatnonzero(alive)
        others = others[(others != i) & (others != j)]
        low_i, high_i = np.minimum(others, i), np.maximum(others, i)
        low_j, high_j = np.minimum(others, j), np.maximum(others, j)
        mixed = ((d[low_i, high_i].astype(np.float64) * size[i] + d[low_j, high_j].astype(np.float64) * size[j]) / (size[i] + size[j])).astype(np.float32)
        d[low_i, high_i] = mixed
        d[low_j, high_j] = np.inf
        d[i, j] = np.inf
        size[i] += size[j]
        alive[j] = False
        before = others[others < i]
        closer = before[(d[before, i] < best[before]) | ((d[before, i] == best[before]) & (i < near[before]))]
        best[closer], near[closer] = d[closer, i], i
        again = np.append(others[((near[others] == i) | (near[others] == j)) & ~np.isin(others, closer)], i)
        near[again] = d[again].argmin(axis=1)
        best[again], best[j] = d[again, near[again]], np.inf
    left, right, height = zip(*merges, strict=True) if merges else ((), (), ())
    return Tree(n, np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(height))


def average_linkage(vectors: np.ndarray, k: int | None = None, threshold: float | None = None) -> np.ndarray:
    """Labels by first appearance of ``k`` groups, or of those that no distance within ``threshold`` joins; without either all are one."""
    return merge_tree(vectors, k, threshold).cut(k, threshold)


def busiest(labels: np.ndarray, durations: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` labels with most speech as 0, 1, ..., ties by first appearance; the rest -1."""
    labels = np.asarray(labels)
    names, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    total = np.bincount(inverse, weights=durations, minlength=len(names))
    order = np.lexsort((first, -total))
    rank = np.empty(len(names), dtype=np.int64)
    rank[order] = np.arange(len(names))
    return np.where(rank < k, rank, C.OTHER_VOICE)[inverse] if len(labels) else labels.astype(np.int64)


def group_centroids(vectors: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels that aren't -1, and the unit vectors of their weighted sums."""
    names = np.unique(labels[labels != C.OTHER_VOICE])
    return names, unit(np.stack([(vectors[labels == l] * weights[labels == l, None]).sum(axis=0) for l in names])) if len(names) else np.zeros((0, 0))


def placed(vectors: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Samples labelled -1 go to the nearest group by its weighted centroid."""
    names, centres = group_centroids(vectors, labels, weights)
    stray = labels == C.OTHER_VOICE
    if not len(names) or not stray.any():
        return labels
    out = labels.copy()
    out[stray] = names[np.argmin(1.0 - vectors[stray] @ centres.T, axis=1)]
    return out


def absorbed(vectors: np.ndarray, labels: np.ndarray, durations: np.ndarray, segments: int = C.TINY_SEGMENTS, ms: float = C.TINY_MS) -> np.ndarray:
    """Groups of too few segments and too little speech move whole to the nearest of the others, all judged once."""
    names, inverse = np.unique(labels, return_inverse=True)
    healthy = (np.bincount(inverse) >= segments) | (np.bincount(inverse, weights=durations) >= ms)
    if len(names) <= 1 or healthy.all() or not healthy.any():
        return renumbered(labels)
    centres = unit(np.stack([vectors[inverse == g].sum(axis=0) for g in range(len(names))]))
    to = np.arange(len(names))
    for g in np.flatnonzero(~healthy):
        to[g] = np.flatnonzero(healthy)[np.argmin(1.0 - centres[healthy] @ centres[g])]
    return renumbered(to[inverse])


def labels_by_policy(vectors: np.ndarray, durations: np.ndarray, k: int | None, background: bool = False) -> np.ndarray:
    """As the engine labels a recording: with the head count known, with intruders about, or by distance alone."""
    vectors, durations = np.asarray(vectors, dtype=np.float64), np.asarray(durations, dtype=np.float64)
    if not len(vectors):
        return np.zeros(0, dtype=np.int64)
    if k is None:
        return absorbed(vectors, average_linkage(vectors, threshold=C.AUTOMATIC_THRESHOLD), durations)
    v = centred(vectors)
    if background:
        return busiest(average_linkage(v, k=k + C.INTRUDER_HEADROOM), durations, k)
    room = min(C.SPLINTER_MOST, len(v) // C.SPLINTER_EVERY)
    return placed(v, busiest(average_linkage(v, k=k + room), durations, k), durations)


# --- on DataFrames, for all recordings --------------------------------------------------------


def _grouped(samples: DataFrame, label, extra: list[str] = ()) -> DataFrame:
    """One recording at a time in idx order; its samples are hundreds, and quadratic work on them stays in one task."""
    kind = samples.schema["recording_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        found = label(np.stack(pdf["vector"].to_numpy()).astype(np.float64), pdf["duration_ms"].to_numpy(dtype=np.float64), pdf)
        return pd.DataFrame({"recording_id": pdf["recording_id"], "idx": pdf["idx"], "label": found})

    return spread.by(samples.select("recording_id", "idx", "vector", "duration_ms", *extra), "recording_id").applyInPandas(run, f"recording_id {kind}, idx long, label long")


def growth(samples: DataFrame, minutes: tuple, threshold: float = C.AUTOMATIC_THRESHOLD) -> DataFrame:
    """(recording_id, minutes, samples, groups, absorbed): voices found by distance alone in the first minutes of each recording, and without tiny groups."""
    kind = samples.schema["recording_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        v, w, end = np.stack(pdf["vector"].to_numpy()).astype(np.float64), pdf["duration_ms"].to_numpy(np.float64), (pdf["end_ms"] - pdf["start_ms"].min()).to_numpy(np.float64)
        rows = []
        for m in minutes:
            on = end <= m * 60_000
            labels = average_linkage(v[on], threshold=threshold)
            rows.append((pdf["recording_id"].iloc[0], float(m), int(on.sum()), len(set(labels.tolist())), len(set(absorbed(v[on], labels, w[on]).tolist())) if on.any() else 0))
        return pd.DataFrame(rows, columns=["recording_id", "minutes", "samples", "groups", "absorbed"])

    return spread.by(samples.select("recording_id", "idx", "vector", "duration_ms", "start_ms", "end_ms"), "recording_id").applyInPandas(run, f"recording_id {kind}, minutes double, samples int, groups int, absorbed int")


def merge_trees(samples: DataFrame) -> DataFrame:
    """(recording_id, step, left, right, height, moved): each recording's merges, until one group is left.

    ``left`` and ``right`` are idx of the groups' first samples, ``moved`` those of all samples of the right one. Whatever is cut
    from a tree, at any count or threshold, reads this table: linkage runs once.
    """
    kind = samples.schema["recording_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        tree, idx = merge_tree(np.stack(pdf["vector"].to_numpy()).astype(np.float64)), pdf["idx"].to_numpy()
        members, rows = {i: [i] for i in range(len(idx))}, []
        for step, (a, b, height) in enumerate(zip(tree.left, tree.right, tree.height, strict=True)):
            rows.append((pdf["recording_id"].iloc[0], step, idx[a], idx[b], height, idx[members[b]]))
            members[a] += members.pop(b)
        return pd.DataFrame(rows, columns=["recording_id", "step", "left", "right", "height", "moved"])

    return spread.by(samples.select("recording_id", "idx", "vector"), "recording_id").applyInPandas(run, f"recording_id {kind}, step int, left long, right long, height double, moved array<long>")


def cut_trees(samples: DataFrame, trees: DataFrame, cuts: DataFrame) -> DataFrame:
    """(recording_id, cut, idx, owner): each sample under each cut with the first sample of its group.

    ``cuts`` has (cut, k, threshold); a cut is by ``k`` groups or, where that is null, before the first merge above ``threshold``. It
    is a small table. A sample's owner is what it was last moved to by then, or itself.
    """
    sizes = samples.groupBy("recording_id").agg(F.count("*").alias("n"))
    over = trees.join(F.broadcast(cuts), F.col("height") > F.col("threshold")).groupBy("recording_id", "cut").agg(F.min("step").alias("over"))
    by_count = F.when(F.col("k").isNotNull(), F.col("n") - F.least(F.greatest("k", F.lit(1)), F.col("n")))
    limits = sizes.crossJoin(F.broadcast(cuts)).join(over, ["recording_id", "cut"], "left").select("recording_id", "cut", F.coalesce(by_count, F.col("over"), F.col("n")).alias("steps"))
    moves = trees.select("recording_id", "step", "left", F.explode("moved").alias("idx"))
    last = moves.join(limits, "recording_id").where(F.col("step") < F.col("steps")).groupBy("recording_id", "cut", "idx").agg(F.max_by("left", "step").alias("owner"))
    return samples.select("recording_id", "idx").join(limits.select("recording_id", "cut"), "recording_id").join(last, ["recording_id", "cut", "idx"], "left").select("recording_id", "cut", "idx", F.coalesce("owner", "idx").alias("owner"))


def sweep(samples: DataFrame, thresholds: tuple) -> DataFrame:
    """(recording_id, threshold, groups, absorbed): groups found by distance alone, and those left when tiny ones are absorbed. One tree serves all thresholds."""
    kind = samples.schema["recording_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        v, w = np.stack(pdf["vector"].to_numpy()).astype(np.float64), pdf["duration_ms"].to_numpy(np.float64)
        tree = merge_tree(v, threshold=max(thresholds))
        found = [(t, tree.cut(threshold=t)) for t in thresholds]
        return pd.DataFrame([(pdf["recording_id"].iloc[0], t, len(set(x.tolist())), len(set(absorbed(v, x, w).tolist()))) for t, x in found], columns=["recording_id", "threshold", "groups", "absorbed"])

    return spread.by(samples.select("recording_id", "idx", "vector", "duration_ms"), "recording_id").applyInPandas(run, f"recording_id {kind}, threshold double, groups long, absorbed long")


def agglomerative(samples: DataFrame, k: int | None = None, threshold: float | None = None) -> DataFrame:
    """(recording_id, idx, label) by average linkage within each recording."""
    return _grouped(samples, lambda v, w, _: average_linkage(v, k, threshold))


def label_speakers(samples: DataFrame, k: int | None = None, background: bool = False) -> DataFrame:
    """(recording_id, idx, label) by the engine's policy; a column ``k`` of the samples overrides the argument."""
    if "k" not in samples.columns:
        return _grouped(samples, lambda v, w, _: labels_by_policy(v, w, k, background))

    def of_row(v, w, pdf):
        own = pdf["k"].iloc[0]
        return labels_by_policy(v, w, None if pd.isna(own) else int(own), background)

    return _grouped(samples, of_row, ["k"])


def keep_busiest(samples: DataFrame, k: int) -> DataFrame:
    """(recording_id, idx, label): of each recording the ``k`` labels with most speech, ranked; the rest -1."""
    totals = samples.groupBy("recording_id", "label").agg(F.sum("duration_ms").alias("_ms"), F.min("idx").alias("_first"))
    rank = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc("_ms"), "_first")) - 1
    ranked = totals.withColumn("_rank", rank).select("recording_id", "label", F.when(F.col("_rank") < k, F.col("_rank")).otherwise(C.OTHER_VOICE).cast("int").alias("_new"))
    return samples.join(ranked, ["recording_id", "label"]).select("recording_id", "idx", F.col("_new").alias("label"))


def place_splinters(samples: DataFrame) -> DataFrame:
    """(recording_id, idx, label): samples labelled -1 go to the nearest group by its weighted centroid."""
    centres = centroids(samples.where(F.col("label") != C.OTHER_VOICE), ["recording_id", "label"])
    near = nearest(samples, centres)
    return near.select("recording_id", "idx", F.when(F.col("label") == C.OTHER_VOICE, F.coalesce("nearest", "label")).otherwise(F.col("label")).cast("int").alias("label"))


def absorb_tiny(samples: DataFrame, segments: int = C.TINY_SEGMENTS, ms: float = C.TINY_MS) -> DataFrame:
    """(recording_id, idx, label): tiny groups move whole to the nearest healthy one; labels renumbered by appearance."""
    groups = samples.groupBy("recording_id", "label").agg(((F.count("*") >= segments) | (F.sum("duration_ms") >= ms)).alias("healthy"))
    centres = centroids(samples, ["recording_id", "label"], weight=None).join(groups, ["recording_id", "label"])
    tiny = centres.where(~F.col("healthy")).select("recording_id", "label", F.col("centroid").alias("vector"))
    moves = nearest(tiny, centres.where("healthy")).select("recording_id", "label", F.col("nearest").alias("_to"))
    moved = samples.join(moves, ["recording_id", "label"], "left").withColumn("label", F.coalesce("_to", "label"))
    first = moved.groupBy("recording_id", "label").agg(F.min("idx").alias("_first"))
    fresh = first.select("recording_id", "label", (F.row_number().over(Window.partitionBy("recording_id").orderBy("_first")) - 1).cast("int").alias("_new"))
    return moved.join(fresh, ["recording_id", "label"]).select("recording_id", "idx", F.col("_new").alias("label"))


def viterbi(samples: DataFrame, penalty: float, tau_ms: float) -> DataFrame:
    """(recording_id, idx, label): labels smoothed in time; a switch costs ``penalty``, less after a gap."""
    kind = samples.schema["recording_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        labels = pdf["label"].to_numpy()
        found = smoothed_labels(np.stack(pdf["vector"].to_numpy()).astype(np.float64), labels, pdf["duration_ms"].to_numpy(np.float64), pdf["start_ms"].to_numpy(np.float64), pdf["end_ms"].to_numpy(np.float64), penalty, tau_ms)
        return pd.DataFrame({"recording_id": pdf["recording_id"], "idx": pdf["idx"], "label": found})

    return spread.by(samples.select("recording_id", "idx", "vector", "label", "duration_ms", "start_ms", "end_ms"), "recording_id").applyInPandas(run, f"recording_id {kind}, idx long, label long")


def smoothed_labels(vectors, labels, weights, start_ms, end_ms, penalty: float, tau_ms: float) -> np.ndarray:
    """The cheapest path through centroids, which are taken in order of first appearance; ties go to the earlier."""
    seen = list(dict.fromkeys(int(l) for l in labels if l != C.OTHER_VOICE))
    if not seen:
        return labels
    names, centres = group_centroids(vectors, labels, weights)
    centres = centres[[list(names).index(l) for l in seen]]
    cost = 1.0 - vectors @ centres.T
    total, back = cost[0].copy(), np.zeros(cost.shape, dtype=np.int64)
    for i in range(1, len(cost)):
        switch = penalty * np.exp(-max(0.0, start_ms[i] - end_ms[i - 1]) / tau_ms)
        via = total[None, :] + switch * (1 - np.eye(len(seen)))
        back[i] = via.argmin(axis=1)
        total = via.min(axis=1) + cost[i]
    path = np.empty(len(cost), dtype=np.int64)
    at = int(total.argmin())
    for i in range(len(cost) - 1, -1, -1):
        path[i], at = seen[at], back[i][at]
    return path
