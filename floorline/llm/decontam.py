"""Benchmark decontamination: one Aho-Corasick automaton over the words of test items, one scan of each text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bounded_batches, kept_rows

#: Words of a window.
WINDOW = 10
#: Bytes of item text that one automaton holds: it takes some 300 times that in a worker. More items make more automata.
AUTOMATON_BYTES = 1 << 19
#: Automata that a worker keeps. With more, it gathers this many bytes of text for each turn through them.
KEPT = 2
TURN_BYTES = 64 << 20

_NOT_WORD = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_NORMAL = bytes(32 if b in _NOT_WORD else b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def normal_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased; maximal runs of what isn't ASCII punctuation, space or control."""
    return text.translate(_NORMAL).split()


#: What stands for a word that is in no item.
_OTHER = "\0\0"


def _sign(n: int) -> str:
    """Two characters for the n-th word, from ranges of their own, so that no match begins within a word."""
    return chr(0x4000 + (n >> 8)) + chr(1 + (n & 0xFF))


class Scanner:
    """The windows of ``items`` (pairs of id and text) in an automaton in which a word is two characters, built once in each worker.

    One character a word would give its nodes thousands of children, which it looks through one by one.
    """

    _built: dict[str, Scanner] = {}

    def __init__(self, items: list[tuple], window: int):
        import ahocorasick

        self.signs: dict[bytes, str] = {}
        owners: dict[str, set] = {}
        for item, text in items:
            signs = [self.signs.setdefault(w, _sign(len(self.signs))) for w in normal_words(text.encode())]
            n = min(window, len(signs))
            for i in range(len(signs) - n + 1 if n else 0):
                owners.setdefault("".join(signs[i : i + n]), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        alike: dict[tuple, tuple] = {}  # most windows are one item's: they share one value
        for pattern, who in owners.items():
            value = (len(pattern) // 2, frozenset(who))
            self.automaton.add_word(pattern, alike.setdefault(value, value))
        self.automaton.make_automaton()
        self.empty = not owners

    @classmethod
    def of(cls, key: str, items: list[tuple], window: int) -> Scanner:
        if (key, window) not in cls._built:
            while len(cls._built) >= KEPT:
                cls._built.pop(next(iter(cls._built)))
            cls._built[key, window] = cls(items, window)
        return cls._built[key, window]

    def hits(self, words: list[bytes], marks: np.ndarray | None, found: set) -> np.ndarray | None:
        """Marks the ``words`` inside occurrences; adds the items to ``found``."""
        if self.empty:
            return marks
        sign = self.signs.get
        for end, (n, who) in self.automaton.iter("".join([sign(w, _OTHER) for w in words])):
            end //= 2
            if marks is None:
                marks = np.zeros(len(words), dtype=bool)
            marks[end - n + 1 : end + 1] = True
            found |= who
        return marks


def spans(text: bytes, marks: np.ndarray) -> list[dict]:
    """Maximal runs of marked words as code point offsets of the original text, end exclusive."""
    at = np.array([m.span() for m in _WORD.finditer(text.translate(_NORMAL))])
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(chars[at[a][0]]), "end": int(chars[at[b - 1][1]])} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def scan_all(texts: list[str | None], slices: list[tuple[str, list[tuple]]], window: int) -> list[tuple[int, np.ndarray | None, set]]:
    """For each text the number of words, which of them are hit (None: none), and the items found; slice after slice."""
    words = [normal_words((text or "").encode()) for text in texts]
    marks: list[np.ndarray | None] = [None] * len(texts)
    found: list[set] = [set() for _ in texts]
    for key, items in slices:
        scanner = Scanner.of(key, items, window)
        for i, own in enumerate(words):
            if own:
                marks[i] = scanner.hits(own, marks[i], found[i])
    return list(zip(map(len, words), marks, found, strict=True))


def scan(text: str | None, slices: list[tuple[str, list[tuple]]], window: int) -> tuple[int, np.ndarray | None, set]:
    return scan_all([text], slices, window)[0]


def slice_of(items: list[tuple]) -> tuple[str, list[tuple]]:
    """A name that depends on what is in it, and the items."""
    return hashlib.sha256(repr(items).encode()).hexdigest(), items


def item_slices(benchmark: DataFrame, item_id: str, text: str, budget: int = AUTOMATON_BYTES) -> list:
    """Broadcasts of the items in slices of ``budget`` bytes; they are read one after the other, never all at once.

    The benchmark is a fixed list of tests that doesn't grow with the corpus. Items with a null id or text take no part.
    """
    context = benchmark.sparkSession.sparkContext
    named = benchmark.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").alias("text"))
    rows = named.where(F.col("item").isNotNull() & F.col("text").isNotNull()).distinct().orderBy("item", "text")
    slices, now, held = [], [], 0
    for item, words in rows.toLocalIterator():
        if now and held + len(words) > budget:
            slices.append(context.broadcast(slice_of(now)))
            now, held = [], 0
        now.append((item, words))
        held += len(words)
    return [*slices, context.broadcast(slice_of(now))] if now else slices


def _turns(batches: Iterator[pa.RecordBatch], column: int, slices: int) -> Iterator[pa.RecordBatch]:
    """The batches; gathered to ``TURN_BYTES`` if there are more automata than are kept, as each is then built once a turn."""
    if slices <= KEPT:
        yield from batches
        return
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(b.column(column).nbytes for b in some) >= TURN_BYTES:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()
            some = []
    if some:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """For each document: its id, ``n_words``, ``n_hit``, ``items`` (ids found, distinct) and ``spans`` (offsets in the text).

    A null or empty text has no words and no hits. Repeated rows are scanned as often as they come. Other columns of
    ``docs`` don't matter and aren't returned. With no items nothing is hit.
    """
    bounded_batches(docs.sparkSession)
    slices = item_slices(benchmark, item_id, item_text)
    key, item = docs.schema[doc_id].dataType, benchmark.schema[item_id].dataType
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField(doc_id, key), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(item)), T.StructField("spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in _turns(batches, 1, len(slices)):
            rows = []
            texts = batch.column(1).to_pylist()
            for words, (n, marks, found) in zip(texts, scan_all(texts, [s.value for s in slices], window), strict=True):
                rows.append((n, 0 if marks is None else int(marks.sum()), sorted(found, key=str), [] if marks is None else spans(words.encode(), marks)))
            columns = [pa.array(list(x), type=f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, list(out)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(out.field(0).type), *columns], schema=out)

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns as they are and whatever their names, whose text holds no window of any item.

    Null and empty texts hold none and stay; repeated rows stay or go together. With no items all stay.
    """
    slices = item_slices(benchmark, item_id, item_text)

    def run(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        for batch in _turns(batches, at, len(slices)):
            clean = [marks is None for _, marks, _ in scan_all(batch.column(at).to_pylist(), [s.value for s in slices], window)]
            yield batch.filter(pa.array(clean, type=pa.bool_()))

    return kept_rows(docs, text, run)
