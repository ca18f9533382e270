"""Language ID by error-correcting output codes: binary n-gram classifiers, one for each bit of the languages' codewords."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import bounded_batches

#: Rows of each language at most that the model is fitted on, and bytes of their whole texts.
SAMPLE_ROWS = 1_500
SAMPLE_BYTES = 4 << 20
#: Binary digits of the hash of ids in bins of which the sample is found.
BIN_BITS = 10
HASHES = 1 << 16
UNKNOWN = "und"
#: Predictions whose codeword isn't ahead of the next by this share of the loss are flagged.
AMBIGUOUS = 0.1


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


PIECE = 1 << 18


def _grams(raw: bytes) -> Iterator[np.ndarray]:
    """Hashed pairs and triples of bytes at each place, piece by piece, so that long texts take bounded memory.

    ``raw`` is folded and has a space at both ends, so a word's edges count too. Pieces overlap by two bytes.
    """
    x = np.frombuffer(b" " + raw + b" ", dtype=np.uint8)
    for i in range(0, max(1, len(x) - 1), PIECE):
        y = x[i : i + PIECE + 2].astype(np.uint32)
        two = (y[:-1] * 257 + y[1:])[:PIECE] * np.uint32(2654435761)
        three = ((y[:-2] * 65537 + y[1:-1]) * np.uint32(40503) + y[2:] * np.uint32(2246822519)) * np.uint32(2654435761)
        yield np.concatenate((two >> np.uint32(17), (three >> np.uint32(17)) + np.uint32(HASHES // 2))).astype(np.int64)


_FOLD = bytes(32 if b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 else b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


def _raw(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_FOLD).split())


def codewords(n: int) -> np.ndarray:
    """Rows of +1 and -1 with distances that are large and even: columns of an exhaustive code, or random ones for many."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        width = 2 ** (n - 1) - 1
        return np.array([[1 if r == 0 else 1 - 2 * ((c >> (n - 1 - r)) & 1) for c in range(1, width + 1)] for r in range(n)])
    rng = np.random.default_rng(n)
    columns = [np.where(rng.permutation(n) < n // 2, 1, -1) for _ in range(max(15, int(np.ceil(10 * np.log2(n)))))]
    return np.stack(columns, axis=1)


@dataclass
class CodeClassifier:
    """Languages, their codewords, and a weight for each hashed n-gram and bit."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for at in _grams(_raw(text)):
            total += self.weights[at].sum(axis=0, dtype=np.float64)
            n += len(at)
        return total / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether another codeword is nearly as near."""
        if text is None or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        z = np.clip(self.margins(text) * 40, -30, 30)
        loss = (np.log1p(np.exp(-self.code * z[None, :])) * self.trust[None, :]).sum(axis=1) / self.trust.sum()
        order = np.argsort(loss, kind="stable")
        share = np.exp(-(loss - loss[order[0]]) * len(z) / 2)
        ahead = (loss[order[1]] - loss[order[0]]) / max(loss[order[1]], 1e-9)
        return self.langs[order[0]], float(share[order[0]] / share.sum()), bool(ahead < AMBIGUOUS)


def fit_texts(samples: dict[str, list[str]]) -> CodeClassifier:
    """Each bit parts the languages in two; its weights are the log odds of n-grams, its trust how often it is right."""
    langs = sorted(k for k, v in samples.items() if any(map(has_letter, v)))
    code = codewords(len(langs))
    counts = np.zeros((len(langs), HASHES))
    for i, lang in enumerate(langs):
        for text in samples[lang]:
            for at in _grams(_raw(text)):
                counts[i] += np.bincount(at, minlength=HASHES)
    rates = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * HASHES)
    weights = np.zeros((HASHES, code.shape[1]), dtype=np.float32)
    for b in range(code.shape[1]) if len(langs) > 1 else ():
        weights[:, b] = np.clip(np.log(rates[code[:, b] > 0].mean(axis=0)) - np.log(rates[code[:, b] < 0].mean(axis=0)), -4, 4)
    model = CodeClassifier(langs, code, weights, np.ones(code.shape[1]))
    if len(langs) > 1:
        right = np.ones((code.shape[1], 2))
        for i, lang in enumerate(langs):
            for text in samples[lang]:
                right[:, 0] += np.sign(model.margins(text)) == code[i]
                right[:, 1] += 1
        model.trust = np.maximum(right[:, 0] / right[:, 1] - 0.5, 0.01)
    return model


def sample(docs: DataFrame, wanted: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """Whole texts of up to ``rows`` rows of each language, the first by a hash of the id, up to ``size`` bytes.

    Ids are ranked in bins of the hash first, so the rows of a frequent language never meet in one task. Of repeated ids the
    least text counts; null ids are one id. Other columns may have any names; an empty table gives no language.
    """
    known = docs.where(wanted & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    known = known.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{doc_id}`")).alias("at"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    shift = 64 - BIN_BITS
    bins = known.groupBy(F.col("lang").alias("_lang"), F.shiftright("at", shift).alias("_bin")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_lang").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a language: where in the hash's range its sample ends, within the last bin it reaches by share of that bin
    last = bins.withColumn("before", before).where(F.col("before") < rows).groupBy("_lang").agg(F.max(F.struct("_bin", "before", "n")).alias("at"))
    within = F.least(F.lit(1.0), (F.lit(rows) - F.col("at.before")) / F.col("at.n"))
    edges = last.select("_lang", (F.shiftleft("at._bin", shift) + F.shiftleft(F.floor(within * ((1 << 40) - 1)), shift - 40)).alias("_last"))  # doubles hold 40 bits exactly
    first = known.join(F.broadcast(edges), F.col("lang") == F.col("_lang")).where(F.col("at") <= F.col("_last"))
    # an id that is repeated without end passes the limit with all its rows: its least text stands for them
    one = first.groupBy("lang", "at", "id").agg(F.min("text").alias("text"))
    found = one.select("lang", "text").orderBy("lang", "at", "id")
    out: dict[str, list[str]] = {}
    held: dict[str, int] = {}
    for name, words in found.toLocalIterator():
        own = out.setdefault(name, [])
        held[name] = held.get(name, 0) + len(words)
        if len(own) < rows and (held[name] <= size or not own):
            own.append(words)
    return out


def fit(docs: DataFrame, wanted: Column, **names) -> CodeClassifier:
    """Learns from the rows with a language for which ``wanted`` holds, a bounded sample of them; with none, all is ``und``."""
    return fit_texts(sample(docs, wanted, **names))


def identify(docs: DataFrame, model: CodeClassifier, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for each row; null texts and those without a letter are ``und``, score 0.

    Whole texts count, of any length; repeated rows come back as often as they came, an empty table gives no rows, and other
    columns may have any names.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: hashes x bits
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.predict(x.as_py()) for x in batch.column(1)]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, schema)
