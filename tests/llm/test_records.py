"""Token records against the tokenizer itself, and what damage and odd rows do."""

from __future__ import annotations

import json
import random
import uuid
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from floorline.llm import records
from floorline.llm.tokens import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string, ids string"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def test_pieces_have_the_ids_of_the_whole_text(plain):
    """Also across odd spaces, marks, apostrophes, special names and signs that only Python takes for space."""
    rng = random.Random(3)
    parts = [*"aB'st.,;|< \n\té̇ḍßΣς１²ⅷ가각ſİ", "́", "\x1c", "\x85", " ", "<|endoftext|>", "it's", " Don't ", "Que.", "été,", "WORLD!!"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)] + ["", " ", "x" * 5000, "a " * 4000, None]
    found = Encoder(FILE).encode(pa.array(texts))
    assert [x.tolist() for x in found] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_forgotten_pieces_are_learnt_again(plain, monkeypatch):
    monkeypatch.setattr("floorline.llm.tokens.KEPT_PIECES", 20)
    encoder, rng = Encoder(FILE), random.Random(5)
    for _ in range(20):
        texts = [" ".join(f"w{rng.randint(0, 60)}x." for _ in range(12)) for _ in range(4)]
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_round_trip(spark, tmp_path, plain):
    """Nulls, ties, repeated rows, a hot id, columns of clashing names: all come back, in order, with true starts."""
    rows = [(i, f"Some text, number {i}. " * (i % 5), "a", "b") for i in range(40, 0, -1)] + [(7, "other", None, "x")] * 2 + [(None, "no id", None, None), (None, None, None, None), (99, None, "", "")] + [(50, f"hot {i % 9}", "", "") for i in range(200)]
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    records.write_records(spark.createDataFrame(rows, SCHEMA).repartition(5), folder, FILE)
    got = records.read_records(spark, folder).select("*", records.ids_crc32().alias("crc")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((i is not None, i or 0, np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t, *_ in rows)
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    assert all(r.crc == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.n_tokens for r in got)
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])[:-1])).tolist()
    files = json.loads(Path(folder, records.MANIFEST).read_text())["files"]
    assert sum(f["records"] for f in files) == len(rows) and sum(f["ids"] for f in files) == sum(r.n_tokens for r in got)


def test_shuffled_reads(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 7), "", "") for i in range(300)]
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    records.write_records(spark.createDataFrame(rows, SCHEMA), folder, FILE)
    plain_ = {tuple(r) for r in records.read_records(spark, folder).collect()}
    one, two = ([tuple(r) for r in records.read_shuffled(spark, folder, s).collect()] for s in (1, 2))
    assert set(one) == set(two) == plain_ and len(one) == len(two) == 300
    assert one != two and [r[0] for r in one] != sorted(r[0] for r in one)


def test_empty_table_and_empty_folder(spark, tmp_path):
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    records.write_records(spark.createDataFrame([], SCHEMA), folder, FILE)
    assert records.read_records(spark, folder).collect() == [] and records.read_shuffled(spark, folder).collect() == []


def test_ids_beyond_two_bytes_and_framing():
    for ids in ([], [1], [65535], [65536, 3], [4294967295]):
        for doc_id in (None, 0, -5, 1 << 62):
            data = records.framed(doc_id, np.array(ids, dtype=np.uint32))
            at = [0]

            def read(n):
                at[0] += n
                return data[at[0] - n : at[0]]

            found, got = records.unframed(read, "x")
            assert (found, got.tolist()) == (doc_id, ids) and records.unframed(read, "x") is None


@pytest.mark.parametrize("at", [0, 9, 14, 25, -2])
def test_damage_is_noticed(spark, tmp_path, at):
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    records.write_records(spark.createDataFrame([(1, "a few words of text", "", "")], SCHEMA), folder, FILE)
    file = max(Path(folder).glob("*.rec"), key=lambda p: p.stat().st_size)
    data = bytearray(file.read_bytes())
    data[at] ^= 4
    file.write_bytes(data)
    with pytest.raises(Exception, match="checksum|cut off"):
        records.read_records(spark, folder).collect()


def test_files_of_failed_attempts_are_not_read(spark, tmp_path):
    """What the manifest doesn't name doesn't exist; a writer that is aborted removes its files."""
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    records.write_records(spark.createDataFrame([(1, "one", "", ""), (2, "two", "", "")], SCHEMA), folder, FILE)
    Path(folder, "left.rec").write_bytes(b"half a rec")
    assert {r.doc_id for r in records.read_records(spark, folder).collect()} == {1, 2}
    for name in ("gone.rec", "gone.idx"):
        Path(folder, name).write_bytes(b"")
    records.RecordWriter(folder, Encoder(FILE), 1).abort([records.Written(0, "gone", 0, 0, 0), None])
    assert not list(Path(folder).glob("gone.*"))
