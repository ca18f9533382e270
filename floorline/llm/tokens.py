"""Whole texts to token ids with the tokenizers library, each word once.

The tokenizer splits at white space first and then works on each piece by itself: nothing that it does (composing
characters, lower-casing, splitting, merging) reaches over a space. So a text's ids are those of its pieces, one after the
other, and most pieces have been seen before. Pieces that a worker doesn't know are encoded by the library and kept.
"""

from __future__ import annotations

import os
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker keeps; when they are so many, the older half is forgotten.
KEPT_PIECES = 600_000
#: A piece of more bytes isn't kept.
LONGEST_KEPT = 64
#: Letters that lower-case one by one and compose with nothing, and perhaps a stop: a word for itself and a stop for itself.
PLAIN = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<stop>[.,;:!?]?)$"
WORD_END = "</w>"


class Encoder:
    """A tokenizer by its file, loaded once in each worker, and the pieces that it knows."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, file: str):
        self.file = file

    def __getstate__(self) -> dict:
        return {"file": self.file}

    def _own(self) -> Encoder:
        own = self._loaded.get(self.file)
        if own is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
            from tokenizers import Tokenizer

            own = Encoder(self.file)
            own.tokenizer, own.young, own.old = Tokenizer.from_file(self.file), {}, {}
            names = own.tokenizer.get_vocab()
            own.ends = np.zeros(max(names.values(), default=0) + 1, dtype=bool)
            own.ends[[i for name, i in names.items() if name.endswith(WORD_END)]] = True
            self._loaded[self.file] = own
        return own

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers; a null text has none."""
        return self._own()._encode(texts)

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        edges = split.offsets.to_numpy() - split.offsets[0].as_py()
        found = split.flatten().dictionary_encode()
        parts = pc.extract_regex(found.dictionary, PLAIN)
        words = pc.utf8_lower(pc.struct_field(parts, 0)).dictionary_encode()
        stops = pc.struct_field(parts, 1).dictionary_encode()
        other = found.dictionary.filter(pc.is_null(parts))
        # ids of words, stops and other pieces end to end, with nothing at the last place
        known = [*self._known(words.dictionary.to_pylist(), self._words), *self._known(stops.dictionary.to_pylist(), self._pieces), *self._known(other.to_pylist(), self._pieces), b""]
        pool = np.frombuffer(b"".join(known), dtype="<u4")
        sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        begins = np.cumsum(sizes) - sizes
        n, m = len(words.dictionary), len(stops.dictionary)
        plain = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        first, second = np.empty(len(plain), dtype=np.int64), np.full(len(plain), len(known) - 1, dtype=np.int64)
        first[plain] = words.indices.drop_null().to_numpy()
        first[~plain] = n + m + np.arange(len(other))
        second[plain] = n + stops.indices.drop_null().to_numpy()
        pieces = found.indices.to_numpy()
        items = np.column_stack((first, second))[pieces].ravel()
        counts = sizes[items]
        ends = np.cumsum(counts)
        ids = pool[np.repeat(begins[items] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.concatenate(([0], ends))[2 * edges]
        return [ids[a:b] for a, b in pairwise(at.tolist())]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words of plain letters. They are encoded as one text: each ends with the one token that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._pieces(words)
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in pairwise([0, *ends.tolist()])]

    def _known(self, pieces: list[str], encoded) -> list[bytes]:
        """The ids of each of ``pieces``; those that are new are ``encoded`` and kept."""
        if len(self.young) > KEPT_PIECES // 2:
            self.old, self.young = self.young, {}
        young, old = self.young.get, self.old.get
        out = [young(p) for p in pieces]
        missed = [i for i, ids in enumerate(out) if ids is None]
        again = [(i, old(pieces[i])) for i in missed]
        new = [i for i, ids in again if ids is None]
        for i, ids in again:
            out[i] = ids
        for i, ids in zip(new, encoded([pieces[i] for i in new]) if new else [], strict=True):
            out[i] = ids
        self.young |= [(pieces[i], out[i]) for i in missed if len(pieces[i]) <= LONGEST_KEPT]
        return out
