"""Ranked lexical search with block-max pruning: a forward index in blocks of documents, and searches of it for sets of queries.

A block holds a run of documents: for each of its terms the documents that have it, the most occurrences in one of them and
the fewest terms of one of them (what bounds a score from above), and the documents' own terms with their counts. A search
bounds each block for each query, sorts blocks by bound, and scores them until the bound drops below the k-th score found.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import bounded_batches, cut, shared_folder

K = 10
#: Documents and bytes of text of a block at most (one document may be longer).
BLOCK_DOCS = 512
BLOCK_BYTES = 4 << 20
#: Bytes of blocks among which a task sorts by bound, and bytes of query text that are searched for in one turn.
TURN_BYTES = 48 << 20
QUERY_BYTES = 4 << 20
# The score's constants.
PERCENT, SLOPE, UNIT, SATURATION = 100, 75, 1_000_000_000, 8

_NOT_TERM = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_NORMAL = bytes(32 if b in _NOT_TERM else b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))

BLOCKS = pa.schema([("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("words", pa.int64()), ("filled", pa.int64()), *((n, pa.binary()) for n in ("vocabulary", "holders", "most", "shortest", "offsets", "terms", "counts"))])


def terms_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; maximal runs of what isn't ASCII punctuation, space or control."""
    return (text or "").encode().translate(_NORMAL).split()


def weight(docs: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holders + 1)))


def damping(lengths: np.ndarray, docs: int, words: int) -> np.ndarray:
    """A document's length against the mean, in percent, by the slope."""
    return PERCENT - SLOPE + (SLOPE * lengths.astype(np.int64) * docs) // max(1, words)


def gain(counts: np.ndarray, damped: np.ndarray) -> np.ndarray:
    """What a term brings before its weight: more with its count, less in long documents."""
    return (UNIT * counts.astype(np.int64)) // (1000 * counts.astype(np.int64) + SATURATION * damped)


class _Builder:
    """One block under construction."""

    def __init__(self):
        self.ids: list = []
        self.lengths: list[int] = []
        self.vocabulary: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = terms_of(text)
        number = self.vocabulary.setdefault
        at = np.fromiter((number(w, len(self.vocabulary)) for w in words), dtype=np.int32, count=len(words))
        terms, counts = np.unique(at, return_counts=True)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.terms.append(terms)
        self.counts.append(counts.astype(np.int32))
        self.held += len(text or "")

    def row(self, name: str) -> tuple:
        terms, counts = np.concatenate(self.terms).astype(np.int32), np.concatenate(self.counts).astype(np.int32)
        lengths, sizes = np.array(self.lengths, dtype=np.int64), [len(t) for t in self.terms]
        n = len(self.vocabulary)
        most, shortest = np.zeros(n, dtype=np.int32), np.full(n, np.iinfo(np.int64).max, dtype=np.int64)
        np.maximum.at(most, terms, counts)
        np.minimum.at(shortest, terms, np.repeat(lengths, sizes))
        holders = np.bincount(terms, minlength=n).astype(np.int32)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        return name, self.ids, lengths.tobytes(), int(lengths.sum()), int((lengths > 0).sum()), b" ".join(self.vocabulary), holders.tobytes(), most.tobytes(), shortest.tobytes(), offsets.tobytes(), terms.tobytes(), counts.tobytes()


def build_index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """The blocks of whole ``docs``, a block of rows that follow one another, as a table in ``folder`` (by default a new one beside
    the checkpoints); nothing is shuffled, and a search reads only the columns that it needs. Ids are integers.

    Null and empty texts are documents without terms. Repeated rows are documents each. Null ids stay null. An empty table has
    no blocks. Other columns don't matter, whatever their names.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        out = lambda b: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(b.row(f"{part}-{n}"), BLOCKS, strict=True)], schema=BLOCKS)
        block = _Builder()
        for batch in batches:
            for i, own in enumerate(batch.column(0).to_pylist()):
                body = batch.column(1)[i].as_py()
                if block.ids and (len(block.ids) >= BLOCK_DOCS or block.held + len(body or "") > BLOCK_BYTES):
                    yield out(block)
                    block, n = _Builder(), n + 1
                block.add(own, body)
        if block.ids:
            yield out(block)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    folder = folder or f"{shared_folder(docs.sparkSession)}/index-{uuid.uuid4().hex}"
    rows.mapInArrow(run, from_arrow_schema(BLOCKS)).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


@dataclass
class Queries:
    """A bounded set of queries: their terms by number with how often each occurs, and the weights."""

    terms: dict[bytes, int]
    bags: list[list[tuple[int, int]]]
    weights: np.ndarray | None = None
    docs: int = 0
    words: int = 0

    @classmethod
    def of(cls, texts: list[str | None]) -> Queries:
        terms: dict[bytes, int] = {}
        return cls(terms, [[(terms.setdefault(w, len(terms)), n) for w, n in Counter(terms_of(t)).items()] for t in texts])


class _Block:
    """What a search reads of a block: first the bounds, and the documents' terms only if a query needs them."""

    def __init__(self, row: dict, queries: Queries):
        self.row, self.queries = row, queries
        words = row["vocabulary"].split(b" ") if row["vocabulary"] else []
        number = queries.terms.get
        self.own = np.fromiter((number(w, -1) for w in words), dtype=np.int64, count=len(words))  # the queries' term for each of the block's
        self.met = np.flatnonzero(self.own >= 0)

    def holders(self) -> tuple[np.ndarray, np.ndarray]:
        return self.own[self.met], np.frombuffer(self.row["holders"], dtype=np.int32)[self.met]

    def bounds(self) -> np.ndarray:
        """For each query a score that none of the block's documents passes."""
        q = self.queries
        most, shortest = np.frombuffer(self.row["most"], dtype=np.int32)[self.met], np.frombuffer(self.row["shortest"], dtype=np.int64)[self.met]
        top = np.zeros(len(q.terms), dtype=np.int64)
        top[self.own[self.met]] = q.weights[self.own[self.met]] * gain(most, damping(shortest, q.docs, q.words))
        return np.array([sum(int(top[t]) * n for t, n in bag) for bag in q.bags], dtype=np.int64)

    def _gains(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By term of the queries: the documents that have it, and what it brings to each."""
        if not hasattr(self, "found"):
            q, row = self.queries, self.row
            lengths = np.frombuffer(row["lengths"], dtype=np.int64)
            terms = self.own[np.frombuffer(row["terms"], dtype=np.int32)]
            offsets = np.frombuffer(row["offsets"], dtype=np.int64)
            kept = np.flatnonzero(terms >= 0)
            docs = np.searchsorted(offsets, kept, side="right") - 1
            terms, counts = terms[kept], np.frombuffer(row["counts"], dtype=np.int32)[kept]
            gains = q.weights[terms] * gain(counts, damping(lengths, q.docs, q.words)[docs])
            order = np.argsort(terms, kind="stable")
            terms, docs, gains = terms[order], docs[order], gains[order]
            edges = np.flatnonzero(np.diff(terms, prepend=-1, append=-1))
            self.found = {int(terms[a]): (docs[a:b], gains[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)} if len(terms) else {}
        return self.found

    def scores(self, query: int) -> np.ndarray:
        found, total = self._gains(), np.zeros(len(self.row["doc_ids"]), dtype=np.int64)
        for term, n in self.queries.bags[query]:
            if term in found:
                docs, gains = found[term]
                total[docs] += n * gains
        return total


def _best(hits: list[tuple], k: int) -> list[tuple]:
    """The first k of (score, doc_id): highest scores first, then small ids, null last."""
    return sorted(hits, key=lambda h: (-h[0], h[1] is None, h[1] or 0))[:k]


def search_blocks(blocks: list[_Block], thresholds: np.ndarray, k: int, best: list[list[tuple]]) -> int:
    """Adds to ``best``, for each query, what of ``blocks`` can be among its k best; returns how many blocks were scored for a query.

    Blocks come in order of their bounds. One whose bound is below the threshold, or the k-th score so far, ends the query.
    """
    scored = 0
    bounds = np.stack([b.bounds() for b in blocks])
    for query in range(bounds.shape[1]):
        own, at = bounds[:, query], best[query]
        for i in np.argsort(-own, kind="stable"):
            least = max(1, int(thresholds[query]), at[-1][0] if len(at) == k else 0)
            if own[i] < least:
                break
            scores = blocks[i].scores(query)
            scored += 1
            hits = np.flatnonzero(scores >= least)
            if len(hits):
                at[:] = _best([*at, *((int(scores[d]), blocks[i].row["doc_ids"][d]) for d in hits)], k)
    return scored


def _turns(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[list[_Block]]:
    """Blocks in lists of ``TURN_BYTES``."""
    some, held = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            if some and held + row.nbytes > TURN_BYTES:
                yield some
                some, held = [], 0
            some.append(_Block(row.to_pylist()[0], queries))
            held += row.nbytes
    if some:
        yield some


def _slices(queries: DataFrame, text: str) -> Iterator[tuple[list, list]]:
    """Queries in lists of ``QUERY_BYTES`` of text at most: (rows' numbers, texts). A list of queries doesn't grow with the corpus."""
    ids, texts, held = [], [], 0
    for row in queries.toLocalIterator():
        if ids and held + len(row[text] or "") > QUERY_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row["_id"])
        texts.append(row[text])
        held += len(row[text] or "")
    if ids:
        yield ids, texts


def _weighed(index: DataFrame, queries: Queries, docs: int, words: int) -> None:
    """Weights of the queries' terms by the documents that hold them, summed up over blocks."""
    held = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value.terms), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                at, n = _Block(row, held.value).holders()
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "n"])

    sums = index.select("vocabulary", "holders").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    holders = {row["term"]: row["n"] for row in sums.toLocalIterator()}
    queries.docs, queries.words = docs, words
    queries.weights = np.array([weight(docs, holders.get(t, 0)) for t in range(len(queries.terms))], dtype=np.int64)


def _hits(index: DataFrame, queries: Queries, thresholds: np.ndarray, k: int) -> DataFrame:
    """(query, score, doc_id): of each task what can be among a query's k best."""
    held = index.sparkSession.sparkContext.broadcast((queries, thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in held.value[0].bags]
        for blocks in _turns(batches, held.value[0]):
            search_blocks(blocks, held.value[1], k, best)
        rows = [(q, score, doc_id) for q, hits in enumerate(best) for score, doc_id in hits]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["query", "score", "doc_id"])

    return index.mapInArrow(run, "query long, score long, doc_id long")


def _first_blocks(index: DataFrame, queries: Queries) -> list[str]:
    """For each query the block with the highest bound: as many names as there are queries."""
    held = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, tuple[int, str]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                for q, bound in enumerate(_Block(row, held.value).bounds().tolist()):
                    if bound > 0:
                        top[q] = max(top.get(q, (0, "")), (bound, row["block"]))
        columns = zip(*((q, *x) for q, x in top.items()), strict=True) if top else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["query", "bound", "block"])

    bounds = index.select("block", "vocabulary", "most", "shortest").mapInArrow(run, "query long, bound long, block string")
    return sorted({row["b"] for row in bounds.groupBy("query").agg(F.max_by("block", F.struct("bound", "block")).alias("b")).toLocalIterator()})


def search(index: DataFrame, queries: DataFrame, *, query_id: str = "item_id", text: str = "text", k: int = K) -> DataFrame:
    """(query_id, rank, doc_id, score): for each row of ``queries`` its k best documents with a score above 0.

    First each query's most promising block is scored; its k-th score is the threshold with which all blocks are searched.
    Equal scores go by ascending id, null last. A query without terms, or whose terms no document has, gives no rows; rows of one
    id are queries each. An empty index or no queries give no rows.
    """
    spark = index.sparkSession
    sums = index.agg(F.sum("filled"), F.sum("words")).first()
    named = cut(queries.select(F.struct(F.col(f"`{query_id}`").alias("id")).alias("_q"), F.col(f"`{text}`").alias("text")).withColumn("_id", F.monotonically_increasing_id()))
    found = spark.createDataFrame([], "_id long, score long, doc_id long")
    for ids, texts in _slices(named.select("_id", "text"), "text"):
        own = Queries.of(texts)
        _weighed(index, own, int(sums[0] or 0), int(sums[1] or 0))
        none = np.zeros(len(ids), dtype=np.int64)
        first = _hits(index.where(F.col("block").isin(_first_blocks(index, own))), own, none, k)
        kth = first.groupBy("query").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), k, 1).alias("kth")).where(F.size("kth") > 0)
        thresholds = none.copy()
        for row in kth.toLocalIterator():
            thresholds[row["query"]] = row["kth"][0]
        names = spark.createDataFrame(list(enumerate(ids)), "query long, _id long")
        found = found.unionByName(_hits(index, own, thresholds, k).join(F.broadcast(names), "query").select("_id", "score", "doc_id"))
    order = Window.partitionBy("_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(named.select("_id", "_q"), "_id").select(F.col("_q.id").alias(query_id), "rank", "doc_id", "score")
