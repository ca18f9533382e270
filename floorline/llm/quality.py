"""Quality classifier by compression: how much better a text packs with a dictionary of good text than with one of bad.

What is packed isn't the wording but its manner: a byte for each word (case, length, whether it has just been said) and the
signs that stand with it. Dictionaries then know how a class writes, in any language, and not what it says, so copies of
labelled texts don't decide their own score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import bounded_batches, kept_rows

#: Labelled rows of each class at most that the model is fitted on, and bytes of their whole texts.
SAMPLE_ROWS = 3_000
SAMPLE_BYTES = 12 << 20
DICTIONARY_BYTES = 32 << 10
#: Bytes that are packed at once: in longer runs a text would be its own dictionary.
WINDOW = 256
LEVEL = 3
#: From this score on a document is predicted to be good.
CUTOFF = 0.3
#: Difference that is damped to a half.
HALF_WAY = 0.05
#: Words whose manner a worker remembers.
REMEMBERED = 50_000

_SIGNS = ".,;:!?()[]\"'"
_codes: dict[str, tuple[bytes, bytes]] = {}
_kinds: dict[tuple[bytes, bytes], tuple[bytes, bytes]] = {}  # words of one manner share one pair


def _code(word: str) -> tuple[bytes, bytes]:
    """Of a word: new, and said just before. Bytes from 128 on; signs follow as they are, three at most."""
    core = word.strip(_SIGNS)
    if core.isupper() and len(core) > 1:
        case = 1
    elif core[:1].isupper():
        case = 2
    else:
        case = 0 if core.isalpha() else 3 if core.isdigit() else 4
    signs = "".join(c for c in word if not c.isalnum()).encode("ascii", "replace")[:3]
    at = 128 + 20 * case + min(len(core), 9)
    return bytes([at]) + signs, bytes([at + 10]) + signs


def manner(text: str | None) -> bytes:
    """How the words of a text are written, line by line; a word counts as said before if it is one of the last three of its line."""
    out, known = [], _codes.get
    for line in (text or "").split("\n"):
        a = b = c = None
        for word in line.split():
            code = known(word)
            if code is None:
                if len(_codes) >= REMEMBERED:
                    _codes.clear()
                    _kinds.clear()
                code = _code(word)
                code = _codes[word] = _kinds.setdefault(code, code)
            out.append(code[word == a or word == b or word == c])
            a, b, c = word, a, b
        out.append(b"\n")
    return b"".join(out)


def damped(difference: float) -> float:
    """Between -1 and 1, in the same order: differences far out tell little more than those near by."""
    return difference / (abs(difference) + HALF_WAY)


@dataclass
class CompressionClassifier:
    """Two zstandard dictionaries and a logistic curve over the normalised difference of compressed sizes."""

    good: bytes
    bad: bytes
    weights: list[float] = field(default_factory=list)
    _packers: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_packers": None}

    def difference(self, text: str | None) -> float:
        """Bytes with the bad dictionary less bytes with the good one, over the smaller of the two."""
        import zstandard

        if not self.good or not self.bad:
            return 0.0
        if self._packers is None:
            plain = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
            dictionaries = [zstandard.ZstdCompressionDict(d) for d in (self.good, self.bad)]  # raw content if it wasn't trained
            for d in dictionaries:
                d.precompute_compress(compression_params=plain)
            self._packers = tuple(zstandard.ZstdCompressor(dict_data=d, compression_params=plain).compress for d in dictionaries)
        with_good, with_bad = self._packers
        raw, good, bad = manner(text), 0, 0
        for i in range(0, len(raw), WINDOW):
            piece = raw[i : i + WINDOW]
            good += len(with_good(piece))
            bad += len(with_bad(piece))
        return (bad - good) / max(1, min(bad, good))

    def score(self, text: str | None) -> float:
        z = self.weights[0] + self.weights[1] * damped(self.difference(text))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """A logistic curve with a ridge on standardised columns: Newton's steps, halved until the loss falls."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    mean[0], sd[0] = 0, 1
    sd[sd == 0] = 1
    z, w, weight = (x - mean) / sd, np.zeros(x.shape[1]), ridge * len(y)

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float(np.logaddexp(0, m).sum() - y @ m + weight / 2 * (w[1:] @ w[1:]))

    shrink = np.full(len(w), weight)
    shrink[0] = 1e-9
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(shrink), z.T @ (y - p) - shrink * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if now - (now := loss(w)) < 1e-9 * max(1.0, abs(now)):
            break
    out = w / sd
    out[0] -= float((w / sd * mean)[1:].sum())
    return out


def _dictionary(texts: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """Trained on windows of the texts' middles, of each about as many, so that long ones don't fill it."""
    import zstandard

    share = max(400, 4 * size // len(texts))
    pieces = []
    for text in texts:
        raw = manner(text)
        start = max(0, (len(raw) - share) // 2)
        pieces += [raw[i : i + WINDOW] for i in range(start, min(len(raw), start + share), WINDOW)]
    try:
        return zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the pieces themselves
        return b"".join(pieces)[:size]


def fit_texts(good: list[str], bad: list[str]) -> CompressionClassifier:
    """Dictionaries from one half of each class, the curve from the other half, so that it sees texts as new ones."""
    if not good or not bad:  # nothing to tell apart: one score for all
        rate = (len(good) + 1) / (len(good) + len(bad) + 2)
        return CompressionClassifier(b"", b"", [float(np.log(rate / (1 - rate))), 0.0])
    model = CompressionClassifier(_dictionary(good[::2]), _dictionary(bad[::2]))
    rest = [(t, 1) for t in good[1::2] or good] + [(t, 0) for t in bad[1::2] or bad]
    x = np.array([[1.0, damped(model.difference(t))] for t, _ in rest])
    model.weights = _logistic(x, np.array([float(y) for _, y in rest])).tolist()
    return model


def labelled(docs: DataFrame, labels: DataFrame, wanted: Column, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> dict[int, list[str]]:
    """Whole texts of labelled rows: of each class the ``rows`` first by a hash of the id, up to ``size`` bytes.

    The documents are read once. Null ids, labels and texts take no part; of repeated ids the least text counts.
    """
    named = labels.where(wanted).select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).where("id is not null")
    order = F.xxhash64("id"), F.col("id")
    classes = [named.where(F.col("label") == value).distinct().orderBy(*order).limit(rows) for value in (0, 1)]
    chosen = F.broadcast(classes[0].unionByName(classes[1]))  # ids and labels of 2 x rows at most
    known = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    found = known.join(chosen, "id").groupBy("label", "id").agg(F.min("text").alias("text")).orderBy("label", *order)
    out: dict[int, list[str]] = {0: [], 1: []}
    held = {0: 0, 1: 0}
    for value, _, words in found.toLocalIterator():
        held[value] += len(words)
        if held[value] <= size or not out[value]:
            out[value].append(words)
    return out


def fit(docs: DataFrame, labels: DataFrame, wanted: Column, **names) -> CompressionClassifier:
    """Learns from a bounded sample of the labelled rows for which ``wanted``, a condition on the labels' id, holds.

    If a class has no such row, all texts score alike.
    """
    texts = labelled(docs, labels, wanted, **names)
    return fit_texts(texts[1], texts[0])


def score_quality(docs: DataFrame, model: CompressionClassifier, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for each row, repeated rows too. A null text scores as an empty one; no other column is read, whatever its name."""
    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[doc_id, "score"])

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: CompressionClassifier, *, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs``, all columns as they are and whatever their names, that score ``cutoff`` or more.

    A null text scores as an empty one. Equal rows stay or go together; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [model.score(x.as_py()) >= cutoff for x in batch.column(at)]
            yield batch.filter(pa.array(good, type=pa.bool_()))

    return kept_rows(docs, text, run)
