"""Exact top-k search: a KD-tree for each shard of vectors, walked best first under bounds, with the k-th score passed on.

Shards are made by median splits too, on a bounded sample, so a shard's box is tight. A first pass takes each query to the
shard whose box promises most; its k-th score there goes with it to those other shards whose box can still beat it. Queries
travel in blocks, a row for each block and shard, and only such as a shard has to see.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, cut

K = 20
SCALE = 64
LEAF = 512
SHARD_ROWS = 32_768
BLOCK_ROWS = 1_024
#: Shards by median splits at most: their boxes are broadcast. With more vectors shards grow.
MOST_SHARDS = 16_384
#: Rows, the first by a hash of the id, on which the splits between shards are fitted, at least four a shard. Every row is indexed.
SAMPLE_ROWS = 16_384
#: Bounds of queries in boxes that are worked out at once.
BOUNDS = 1 << 21
#: Parts in which a query's finds from many shards are ranked first.
LISTS = 64

_NONE, _FAR = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Tree:
    """Vectors under nodes made by median splits on the widest side, each node with its tight box."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.largest = int(np.abs(self.rows).max(initial=0))
        low, high, self.children, self.members = [], [], [], []
        todo = [np.arange(len(ids))] if len(ids) else []
        while todo:  # breadth first: a node's children come after it
            parts = []
            for at in todo:
                own = self.rows[at]
                low.append(own.min(axis=0))
                high.append(own.max(axis=0))
                spread = high[-1].astype(np.int64) - low[-1]
                if len(at) <= leaf or not spread.any():
                    self.children.append(None)
                    self.members.append(np.sort(at))
                    continue
                halves = np.argsort(own[:, int(spread.argmax())], kind="stable")
                self.children.append(None)  # set below
                self.members.append(None)
                parts += [at[halves[: len(at) // 2]], at[halves[len(at) // 2 :]]]
            todo = parts
        inner = [i for i, m in enumerate(self.members) if m is None]  # their children follow the root in the same order
        for n, i in enumerate(inner):
            self.children[i] = (2 * n + 1, 2 * n + 2)
        self.low = np.stack(low) if low else np.zeros((0, rows.shape[1]), rows.dtype)
        self.high = np.stack(high) if high else self.low


def _pad(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The most that a vector within each box can score with each query."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class Best:
    """The k best (score, id) of each query so far, best first; ids tie to the smaller. ``floor`` is known from elsewhere."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.scores, self.ids = k, np.full((n, k), _NONE), np.full((n, k), _FAR)
        self.floor = np.full(n, _NONE) if floor is None else floor

    def least(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What a score has to reach to count."""
        return np.maximum(self.scores[at, -1], self.floor[at])

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """New ``scores`` (queries ``at`` x candidates ``ids``); ``none`` marks what isn't a candidate."""
        scores = np.where(none, _NONE, scores)
        scores[scores < self.least(at)[:, None]] = _NONE
        on = (scores > _NONE).any(axis=1)
        if not on.any():
            return
        at, scores = at[on], scores[on]
        if scores.shape[1] > self.k:
            # what is below the k-th of the new ones can't count; ties with it stay
            floor = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            some = np.flatnonzero((scores >= np.maximum(floor, _NONE + 1)[:, None]).any(axis=0))
            pick = some[np.argsort(~scores[:, some], axis=1, kind="stable")[:, : self.k]]  # candidates come by id, so ties keep the smaller
        else:
            pick = np.argsort(~scores, axis=1, kind="stable")
        found = np.take_along_axis(scores, pick, 1)
        who = np.where(found == _NONE, _FAR, ids[pick])
        both, names = np.concatenate((self.scores[at], found), axis=1), np.concatenate((self.ids[at], who), axis=1)
        order = np.lexsort((names, ~both), axis=1)[:, : self.k]
        self.scores[at], self.ids[at] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, best: Best) -> int:
    """Brings ``best`` up to date with the tree; returns how many pairs of a query and a vector the bounds saved.

    Best first: of all nodes that some query can still gain by, the one of the highest bound is next. A query goes on below a
    node only if its bound there isn't below its k-th score; one that equals it may still bring a smaller id.
    """
    if not len(tree.low) or not len(queries):
        return 0
    width = max(queries.shape[1], tree.rows.shape[1])
    q, rows, low, high = _pad(queries, width), _pad(tree.rows, width), _pad(tree.low, width), _pad(tree.high, width)
    # floats hold the products exactly below these sizes
    size = max(1, width) * max(1, tree.largest) * max(1, int(np.abs(q).max(initial=0)))
    kind = np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else object
    q, rows, low, high = q.astype(kind), rows.astype(kind), low.astype(kind), high.astype(kind)
    all_ = np.arange(len(q))
    first = bounds(q, low[:1], high[:1])[:, 0]
    queue, visited = [(-first.max(), 0, all_, first)], 0
    while queue:
        _, node, at, reach = heapq.heappop(queue)
        go = reach >= best.least(at)
        at = at[go]
        if not len(at):
            continue
        members = tree.members[node]
        if members is not None:
            visited += len(at) * len(members)
            best.add(at, (q[at] @ rows[members].T).astype(np.int64), tree.ids[members], ids[at][:, None] == tree.ids[members][None, :])
            continue
        for child in tree.children[node]:
            below = bounds(q[at], low[child : child + 1], high[child : child + 1])[:, 0]
            heapq.heappush(queue, (-below.max(), child, at, below))
    return len(q) * len(tree.ids) - visited


def whole_numbers(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(id, vec) with vec = floor(scale * component); rows with a null or non-finite component, or no id, are left out."""
    named = vectors.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{embedding}`").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return named.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col("id").cast("long").alias("id"), F.transform("vec", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec")
    )


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Lists as rows; shorter ones are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def median_splits(x: np.ndarray, shards: int) -> list[tuple]:
    """A binary tree of ``shards`` leaves as a list of (side, value, left, right); a negative child -1 - s is shard s."""
    nodes: list[tuple] = []

    def grow(at: np.ndarray, first: int, n: int) -> int:
        if n == 1:
            return -1 - first
        spread = np.ptp(x[at], axis=0) if len(at) and x.shape[1] else np.zeros(1)
        side = int(spread.argmax())
        value = np.partition(x[at, side], len(at) * (n // 2) // n)[len(at) * (n // 2) // n] if len(at) and x.shape[1] else 0
        mine = len(nodes)
        nodes.append(())
        low = x[at, side] < value if x.shape[1] else np.zeros(len(at), bool)
        nodes[mine] = (side, int(value), grow(at[low], first, n // 2), grow(at[~low], first + n // 2, n - n // 2))
        return mine

    return nodes if grow(np.arange(len(x)), 0, shards) >= 0 else []


def shard_of(x: np.ndarray, nodes: list[tuple]) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.int32)
    todo = [(0, np.arange(len(x)))] if nodes else []
    while todo:
        node, at = todo.pop()
        if node < 0:
            out[at] = -1 - node
            continue
        side, value, left, right = nodes[node]
        low = (x[at, side] if side < x.shape[1] else np.zeros(len(at), np.int64)) < value
        todo += [(left, at[low]), (right, at[~low])]
    return out


def _indexed(rows: DataFrame, shards: int, shard_rows: int) -> DataFrame:
    """(shard, body, low, high): a tree for each shard in one value of bounded size, and its box.

    Equal vectors, and those beside splits that the sample got wrong, can make a shard too large: it is cut by a hash of
    the id into parts, each a shard of its own.
    """
    context = rows.sparkSession.sparkContext
    some = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(max(SAMPLE_ROWS, 4 * shards)).toArrow()["vec"].combine_chunks() if shards > 1 else None
    held = context.broadcast(median_splits(_matrix(some), shards) if some is not None else [])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(_matrix(batch.column(1)), held.value)), batch.column(0), batch.column(1)], names=["shard", "id", "vec"])

    dealt = rows.mapInArrow(deal, "shard int, id long, vec array<long>")
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n"))  # a line a shard
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(2 * shard_rows))).cast("int")
    met = dealt.join(F.broadcast(sizes.select("shard", parts.alias("parts"))), "shard")
    met = met.select("shard", F.pmod(F.xxhash64("id", "vec"), F.col("parts")).cast("int").alias("part"), "id", "vec")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(some).combine_chunks()
            x = _matrix(whole["vec"].combine_chunks())
            made = Tree(whole["id"].to_numpy(), x.astype(np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int64))
            box = [pa.array([v.astype(np.int64).tolist()], pa.list_(pa.int64())) for v in (made.low[0], made.high[0])]
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary()), *box], names=["body", "low", "high"])

        now, some = None, []
        for batch in batches:  # by shard and part
            keys = np.stack([batch.column(i).to_numpy() for i in range(2)], axis=1)
            edges = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True]))) if len(keys) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                key = tuple(keys[a])
                if key != now and some:
                    yield tree(some)
                    some = []
                now = key
                some.append(batch.slice(a, b - a).select(["id", "vec"]))
        if some:
            yield tree(some)

    trees = met.repartition("shard", "part").sortWithinPartitions("shard", "part").mapInArrow(build, "body binary, low array<long>, high array<long>")
    return cut(trees.select(F.xxhash64("body").alias("shard"), "body", "low", "high"))


def _asked(held, batches: Iterator[pa.RecordBatch], block_rows: int, wants) -> Iterator[pa.RecordBatch]:
    """Rows (shard, block): blocks of packed queries for the shards that ``wants`` (bounds, extra) marks for each query."""
    names, low, high = held.value
    waiting: dict[int, list] = {}

    def out(s: int) -> pa.RecordBatch:
        some = waiting.pop(s)
        width = max(x.shape[1] for _, x, *_ in some)
        packed = (np.concatenate([i for i, *_ in some]), np.concatenate([_pad(x, width) for _, x, _ in some]), np.concatenate([f for *_, f in some]))
        return pa.RecordBatch.from_arrays([pa.array([names[s]], pa.int64()), pa.array([pickle.dumps(packed)], pa.binary())], names=["shard", "block"])

    step = max(1, BOUNDS // max(1, len(names)))
    pieces = ((ids[i : i + step], x[i : i + step], floor[i : i + step], seen[i : i + step]) for ids, x, floor, seen in batches for i in range(0, len(ids), step))
    for ids, x, floor, seen in pieces:
        width = max(x.shape[1], low.shape[1])
        q = _pad(x, width)
        reach = bounds(q.astype(np.float64), _pad(low, width).astype(np.float64), _pad(high, width).astype(np.float64))
        marked = wants(reach, floor, seen, names)
        small = x.astype(np.int16) if np.abs(x).max(initial=0) < 1 << 15 else x
        for s in np.flatnonzero(marked.any(axis=0)).tolist():
            on = marked[:, s]
            waiting.setdefault(s, []).append((ids[on], small[on], floor[on]))
            if sum(len(i) for i, *_ in waiting[s]) >= block_rows:
                yield out(s)
    for s in list(waiting):
        yield out(s)


def top_k(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query with all rows but those of its id.

    ``is_query`` is a condition on the id, named ``id``. Ties go to the smaller id; with fewer candidates all come back.
    Vectors that are null, or hold a null or non-finite component, take no part, nor do rows without an id. Repeated ids
    are candidates each, and equal queries of one id are one query. Vectors of unequal length count as filled with zeros.
    Other columns may have any names; an empty table gives no rows.
    """
    bounded_batches(vectors.sparkSession)
    rows = whole_numbers(vectors, vec_id, embedding, scale)
    n = rows.count()
    indexed = _indexed(rows, min(MOST_SHARDS, max(1, -(-n // shard_rows))), max(shard_rows, -(-n // MOST_SHARDS)))
    boxes = indexed.select("shard", "low", "high").orderBy("shard").toArrow()  # a line a shard
    columns = [boxes[c].combine_chunks() for c in ("low", "high")]
    held = rows.sparkSession.sparkContext.broadcast((boxes["shard"].to_numpy(), *(_matrix(c) if len(c) else np.zeros((0, 0), np.int64) for c in columns)))
    packed, found_schema = "shard long, block binary", "query_id long, vec array<long>, at long, vec_id array<long>, score array<long>"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def wants(reach, floor, seen, names):
            return np.arange(len(names))[None, :] == reach.argmax(axis=1)[:, None]

        some = ((b.column(0).to_numpy(), _matrix(b.column(1)), np.full(b.num_rows, _NONE), np.zeros(b.num_rows, np.int64)) for b in batches if b.num_rows)
        yield from _asked(held, some, block_rows, wants)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def wants(reach, floor, seen, names):
            return (reach >= floor[:, None]) & (names[None, :] != seen[:, None])

        some = ((b.column(0).to_numpy(), _matrix(b.column(1)), b.column(2).to_numpy(), b.column(3).to_numpy()) for b in batches if b.num_rows)
        yield from _asked(held, some, block_rows, wants)

    def look(batches: Iterator[pa.RecordBatch], first_pass: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, body, block in zip(*batch.columns, strict=True):
                ids, x, floor = pickle.loads(block.as_py())
                best = Best(len(ids), k, floor)
                search(pickle.loads(body.as_py()), ids, x.astype(np.int64), best)
                if not first_pass and not (on := (best.ids != _FAR).any(axis=1)).all():  # most gain nothing by another shard
                    ids, x, best.ids, best.scores = ids[on], x[on], best.ids[on], best.scores[on]
                lists = lambda values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum((best.ids != _FAR).sum(axis=1)))), pa.int32()), pa.array(values[best.ids != _FAR]))
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * x.shape[1], pa.int32()), pa.array(x.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), vec, pa.array(np.full(len(ids), shard.as_py())), lists(best.ids), lists(best.scores)], names=["query_id", "vec", "at", "vec_id", "score"])

    def searched(asked: DataFrame, first_pass: bool) -> DataFrame:
        return cut(asked.join(indexed.select("shard", "body"), "shard").select("shard", "body", "block").mapInArrow(lambda some: look(some, first_pass), found_schema))

    one = searched(rows.where(is_query).select("id", "vec").dropDuplicates().mapInArrow(first, packed), True)
    # the k-th score, or none if the first shard didn't have k
    floor = F.when(F.size("score") >= k, F.element_at("score", k)).otherwise(F.lit(_NONE))
    two = searched(one.select("query_id", "vec", floor.alias("floor"), "at").mapInArrow(rest, packed), False)
    pair = F.transform(F.arrays_zip("vec_id", "score"), lambda x: F.struct((-x["score"]).alias("s"), x["vec_id"].alias("vec_id")))
    lists = one.unionByName(two).select("query_id", F.xxhash64("vec").alias("vec"), F.pmod(F.xxhash64("at"), F.lit(LISTS)).alias("part"), pair.alias("x"))
    best = lambda x: F.slice(F.sort_array(F.flatten(F.collect_list(x))), 1, k).alias("x")
    best_of = lists.groupBy("query_id", "vec", "part").agg(best("x")).groupBy("query_id", "vec").agg(best("x"))
    return best_of.select("query_id", F.posexplode("x").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
