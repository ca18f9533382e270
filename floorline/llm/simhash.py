"""SimHash near-dedup: fingerprints of word shingles, linked by generalised pigeonhole search in Hamming space.

Bits that go together share a partition. A dynamic program gives each partition a threshold of its own from the
candidates it would bring, so that thresholds plus one add up to the distance plus one: two fingerprints within the
distance then agree in some partition within its threshold. Each fingerprint is filed under the variants of its
partition within half that threshold, two that belong together meet under one of them and are verified there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bounded_batches, cut
from .components import components

SHINGLE_WORDS = 4
SEED = 42
DISTANCE = 4
BITS = 64
PARTITIONS = 2
#: Fingerprints under one variant that are compared with each other in one task; larger sets meet at their midpoints.
BUCKET = 65_536
#: Parts into which the members of a component are dealt where they meet its name.
SALTS = 16
#: Copies from which on a fingerprint's rows aren't shuffled to meet its component; such fingerprints are broadcast, so they are
#: limited to this many, whatever the number of rows.
COPIES = 1_000
MOST_HOT = 50_000
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Bit i is set if bit i is set in over half the hashes of the shingles; 0 if there are no words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    stops = ends[len(words) - n :].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), dtype=np.uint64, count=n)
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, _CHUNK):
        counts += np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=[doc_id, "fp"])

    return docs.select(doc_id, text).mapInArrow(run, schema)


def _values(batch: pa.RecordBatch, name: str = "fp") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).view(np.uint64)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def joint_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often bits i and j are set together, over all rows: 64 x 64 numbers at any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = _bits(_values(batch)).astype(np.float32)
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS + 1), pa.int32()), pa.array([*total.ravel().astype(np.int64).tolist(), n], pa.int64())], names=["at", "n"])

    rows = prints.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for at, n in rows:
        flat[at] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, joint: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of equal width; each takes next the bit that correlates most with the bits it has."""
    p = np.diag(joint) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((joint / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - k)
        order = sorted(free)
        own = [max(order, key=lambda b: (corr[b, order].sum(), -b))]
        while len(own) < width:
            own.append(max((b for b in order if b not in own), key=lambda b: (corr[b, own].sum(), -b)))
        out.append(sorted(own))
        free -= set(own)
    return out


def pack(values: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(values), dtype=np.uint64)
    for k, b in enumerate(bits):
        out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def distance_shares(prints: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """For each partition, the share of pairs at each distance within it.

    Exact for blocks of 8 bits (histograms of 256 values over all rows), as if blocks were independent beyond that.
    """
    blocks = [(g, bits[i : i + 8]) for g, bits in enumerate(groups) for i in range(0, len(bits), 8)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(blocks), 256), dtype=np.int64)
        for batch in batches:
            x = _values(batch)
            for k, (_, bits) in enumerate(blocks):
                total[k] += np.bincount(pack(x, bits).astype(np.int64), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "n"])

    flat = np.zeros(len(blocks) * 256)
    for at, n in prints.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        flat[at] = n
    apart = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
    out = [np.ones(1) for _ in groups]
    for (g, _), counts in zip(blocks, flat.reshape(-1, 256), strict=True):
        p = counts / max(counts.sum(), 1)
        out[g] = np.convolve(out[g], np.bincount(apart.ravel(), weights=np.outer(p, p).ravel(), minlength=9))
    return out


def allocate(n: int, shares: list[np.ndarray], widths: list[int], distance: int) -> list[int]:
    """Thresholds (-1: unused) of least cost with the sum of threshold + 1 equal to distance + 1."""

    def cost(g: int, t: int) -> float:
        if t < 0:
            return 0.0
        filed = sum(len(list(combinations(range(widths[g]), r))) for r in range((t + 1) // 2 + 1))
        return n * filed + n * n / 2 * float(shares[g][: t + 1].sum()) / 8

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g in range(len(shares)):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, distance - used + 1):
                new = (c + cost(g, t), [*ts, t])
                if used + t + 1 not in step or new < step[used + t + 1]:
                    step[used + t + 1] = new
        best = step
    return best[distance + 1][1]


def ball(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], dtype=np.uint64)


def _file(prints: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(part, variant, fp): each fingerprint under the variants of each of its partitions."""
    masks = {g: ball(len(groups[g]), (t + 1) // 2) for g, t in enumerate(thresholds) if t >= 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _values(batch)
            for g, mask in masks.items():
                step = max(1, 200_000 // len(mask))
                for i in range(0, len(x), step):
                    some = x[i : i + step]
                    keys = (pack(some, groups[g])[:, None] ^ mask[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), g, dtype=np.int32)), pa.array(keys.view(np.int64)), pa.array(np.repeat(some, len(mask)).view(np.int64))], names=["part", "variant", "fp"])

    return prints.select("fp").mapInArrow(run, "part int, variant long, fp long")


def _reach(values: np.ndarray, distance: int) -> np.ndarray:
    """For each of ``values`` the index of the first of its component: breadth first, each against those not yet reached."""
    root = np.zeros(len(values), dtype=np.int64)
    left = np.arange(len(values))
    while len(left):
        seed, left = left[0], left[1:]
        root[seed] = seed
        front = np.array([seed])
        while len(front) and len(left):
            now, front = front[:64], front[64:]
            near = (np.bitwise_count(values[now][:, None] ^ values[left][None, :]) <= distance).any(axis=0)
            root[left[near]] = seed
            front = np.concatenate((front, left[near]))
            left = left[~near]
    return root


def _forest(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within ``distance`` under a common key; rows come sorted by key."""
    a, b = [], []
    edge = np.flatnonzero(np.concatenate(([True], np.any(key[1:] != key[:-1], axis=1), [True])))
    size = np.diff(edge)
    for at, n in zip(edge[:-1][size > 24], size[size > 24], strict=True):
        root = _reach(fp[at : at + n], distance)
        far = np.flatnonzero(root != np.arange(n))
        a.append(fp[at + far])
        b.append(fp[at + root[far]])
    at, n = edge[:-1][(size > 1) & (size <= 24)], size[(size > 1) & (size <= 24)]
    rank = np.concatenate([np.arange(k) for k in range(2, 25) for _ in range(int((n == k).sum()))]) if len(n) else np.zeros(0, dtype=np.int64)
    order = np.argsort(n, kind="stable")
    rows = np.repeat(at[order], n[order]) + rank
    room = np.repeat(n[order], n[order]) - rank
    for d in range(1, 24):
        rows, room = rows[room > d], room[room > d]
        if not len(rows):
            break
        near = np.bitwise_count(fp[rows] ^ fp[rows + d]) <= distance
        a.append(fp[rows[near]])
        b.append(fp[rows[near] + d])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _links_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1) if len(a) else np.zeros((2, 0), np.uint64)
    n = pairs.shape[1]
    return pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64)), pa.array(np.full(n, -1, np.int32)), pa.array(np.zeros(n, np.int64))], names=["a", "b", "part", "variant"])


def _verify(filed: DataFrame, distance: int, bucket: int) -> DataFrame:
    """(a, b, part, variant): links (part -1), or members a of sets larger than ``bucket`` with where they met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # columns part, variant, fp
        n, over = 0, None

        def rest(rows: np.ndarray) -> pa.RecordBatch:
            x = rows[:, 2].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(x), pa.array(rows[:, 0].astype(np.int32)), pa.array(np.ascontiguousarray(rows[:, 1]).view(np.int64))], names=["a", "b", "part", "variant"])

        def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole sets: those within ``bucket`` are compared, larger ones go on to their midpoints."""
            if not len(rows):
                return
            edge = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1), [True])))
            large = np.repeat(np.diff(edge) > bucket, np.diff(edge))
            if large.any():
                yield rest(rows[large])
                rows = rows[~large]
            if len(rows):
                yield _links_of(*_forest(rows[:, :2], np.ascontiguousarray(rows[:, 2]), distance))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(0).to_numpy().astype(np.uint64), *(_values(batch, c) for c in ("variant", "fp"))], axis=1)
            if over is not None:  # the set that was too large goes on
                same = (rows[:, :2] == over).all(axis=1)
                yield rest(rows[same])
                rows = rows[~same]
                if not len(rows):
                    continue
                over = None
            held.append(rows)
            n += len(rows)
            if n < 4 * _CHUNK:
                continue
            rows = np.concatenate(held)
            first = int(np.argmax((rows[:, :2] == rows[-1, :2]).all(axis=1)))  # where the last set begins
            yield from work(rows[:first])
            rows = rows[first:]
            if len(rows) > bucket:
                over = rows[-1, :2].copy()
                yield rest(rows)
                rows = rows[:0]
            held, n = [rows], len(rows)
        if held:
            yield from work(np.concatenate(held))

    schema = "a long, b long, part int, variant long"
    return filed.repartition("part", "variant").sortWithinPartitions("part", "variant", "fp").mapInArrow(run, schema)


def _midpoints(over: DataFrame, groups: list[list[int]], distance: int) -> DataFrame:
    """Links within sets that were too large, by a count of rows that is linear in their size.

    Two fingerprints are within an even ``distance`` just if some 64-bit value is within half of it from both. Those
    of a set share its variant on the partition, so the rest of the value is all that has to be listed.
    """
    half = distance // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x, parts, variants = _values(batch, "a"), batch.column(1).to_numpy(), _values(batch, "variant")
            for g in np.unique(parts).tolist():
                inside, outside = groups[g], [b for b in range(BITS) if b not in groups[g]]
                on = parts == g
                some, want = x[on], np.zeros(int(on.sum()), dtype=np.uint64)
                for k, b in enumerate(inside):
                    want |= ((variants[on] >> np.uint64(k)) & np.uint64(1)) << np.uint64(b)
                inner = np.uint64(sum(1 << b for b in inside))
                off = np.bitwise_count((some & inner) ^ want)
                for d in range(half + 1):
                    if (g, d) not in masks:
                        masks[g, d] = np.array([sum(1 << outside[i] for i in c) for r in range(half - d + 1) for c in combinations(range(len(outside)), r)], dtype=np.uint64)
                    mask, own = masks[g, d], np.flatnonzero(off == d)
                    for i in range(0, len(own), step := max(1, 200_000 // len(mask))):
                        at = own[i : i + step]
                        middle = (((some[at] & ~inner) | want[at])[:, None] ^ mask[None, :]).ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(middle.view(np.int64)), pa.array(np.repeat(some[at], len(mask)).view(np.int64))], names=["middle", "fp"])

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = hub = None
        for batch in batches:
            if not batch.num_rows:
                continue
            m, x = _values(batch, "middle"), _values(batch, "fp")
            start = np.concatenate(([middle is None or m[0] != middle], m[1:] != m[:-1]))
            hubs = np.where(start, x, 0 if hub is None else hub)
            at = np.maximum.accumulate(np.where(start, np.arange(len(m)), -1))
            first = np.where(at >= 0, hubs[np.maximum(at, 0)], hub if hub is not None else x[0]).astype(np.uint64)
            middle, hub = m[-1], first[-1]
            on = first != x
            pairs = np.unique(np.stack((first[on], x[on])), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[0]).view(np.int64)), pa.array(np.ascontiguousarray(pairs[1]).view(np.int64))], names=["a", "b"])

    rows = over.select("a", "part", "variant").mapInArrow(run, "middle long, fp long")
    return rows.repartition("middle").sortWithinPartitions("middle", "fp").mapInArrow(star, "a long, b long")


def link_fingerprints(prints: DataFrame, *, distance: int = DISTANCE, parts: int = PARTITIONS, bucket: int = BUCKET) -> DataFrame:
    """``prints`` (fp, distinct) to (a, b): links whose components are those of all pairs within ``distance``.

    ``distance`` is even. Sets larger than ``bucket`` are not compared pair by pair but meet at midpoints; nothing is dropped.
    """
    n, joint = joint_counts(prints)
    groups = group_bits(n, joint, parts)
    thresholds = allocate(n, distance_shares(prints, groups), [len(g) for g in groups], distance)
    found = cut(_verify(_file(prints, groups, thresholds), distance, bucket))
    links = found.where("part = -1").select("a", "b")
    over = found.where("part <> -1")
    return links if over.isEmpty() else links.union(_midpoints(over, groups, distance))


def candidates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(a, b): pairs of the ids of ``docs``, which are longs, whose components are those of all texts with fingerprints within ``distance``.

    Of texts with one fingerprint the least id stands for all: the others are paired with it, and it with those of fingerprints that are linked.
    """
    prints = cut(fingerprints(docs, doc_id, text).distinct())
    first = cut(prints.groupBy("fp").agg(F.min(doc_id).alias("a")))
    same = prints.join(first, "fp").select("a", F.col(doc_id).alias("b"))
    links = link_fingerprints(first.select("fp"), distance=distance).toDF("fp", "fp_b")
    apart = links.join(first, "fp").join(first.toDF("fp_b", "b"), "fp_b").select("a", "b")
    return same.union(apart).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, parts: int = PARTITIONS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component): one row for each row of ``docs``; component is the least id that its links reach.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows come back as often as they
    came. Null ids get a row and count for links, but name no component; a component of null ids alone has a null name.
    """
    all_ = cut(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))))
    prints = cut(all_.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")))
    roots = components(link_fingerprints(prints.select("fp"), distance=distance, parts=parts, bucket=bucket))
    # most fingerprints are linked with none and name themselves; the others meet the name of their root by salt, so that a
    # large component fills no task
    linked = cut(prints.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "least", "root"))
    tops = prints.join(roots.select(F.col("root").alias("fp")).distinct(), "fp", "left_semi").withColumn("root", F.col("fp"))
    linked = linked.unionByName(tops.select("fp", "least", "root"))
    names = linked.groupBy("root").agg(F.min("least").alias("component")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(names, ["root", "salt"]).select(F.col("fp").alias("_fp"), "component")
    each = cut(prints.join(named, F.col("fp") == F.col("_fp"), "left").select("fp", "times", F.when(F.col("_fp").isNotNull(), F.col("component")).otherwise(F.col("least")).alias("component")))
    # fingerprints of very many copies are few: their rows learn the component where they are
    most = max(COPIES, all_.count() // MOST_HOT)
    hot = each.where(F.col("times") > most).select(F.col("fp").alias("_fp"), F.col("component").alias("_component"))
    marked = all_.join(F.broadcast(hot), F.col("fp") == F.col("_fp"), "left")
    copies = marked.where("_fp is not null").select("doc_id", "fp", F.col("_component").alias("component"))
    others = marked.where("_fp is null").select("doc_id", "fp").join(each.where(F.col("times") <= most).select("fp", "component"), "fp")
    return copies.unionByName(others.select("doc_id", "fp", "component")).withColumnRenamed("doc_id", doc_id)
