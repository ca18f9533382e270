"""Cascading release against a replay turn by turn, and tree contraction against plain evaluation."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from floorline.llm import release

TURNS = "conv_id long, turn long, role string, text string, p string, parent string"
NODES = "conv string, p long, parent long, pieces array<struct<lo:bigint,add:bigint,moves:boolean>>"


def plain(rows: list[tuple]) -> list[tuple]:
    """(conv_id, turn, text) to the result's rows."""
    by = defaultdict(list)
    for conv, turn, text in rows:
        by[conv].append((turn, zlib.crc32((text or "").encode())))
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        done = []
        for p, (turn, crc) in enumerate(turns):
            h = lambda k: zlib.crc32(f"{k}:{'null' if conv is None else conv}:{'null' if turn is None else turn}".encode())  # noqa: B023, E731
            back, arrival = h(0) % 3, 7 * p
            above = done[p - back] if 0 < back <= p else None
            if above and above[0] != "delivered":
                done.append(("blocked", 0, None, None, turn, crc))
                continue
            at = first = max(arrival, above[3] if above else 0)
            faulty, repaired = h(1) % 101 < 35, arrival + h(2) % 101
            for a in range(1, 6):
                if not faulty or not (at < repaired or h(a + 2) % 3 == 0):
                    done.append(("delivered", a, first, at, turn, crc))
                    break
                if a == 5:
                    done.append(("dead", 5, first, at, turn, crc))
                    break
                at += 10 * 2 ** (a - 1)
        state, numbers = 0, {}
        for n, i in enumerate(sorted((i for i, d in enumerate(done) if d[0] == "delivered"), key=lambda i: (done[i][3], done[i][4] is not None, done[i][4] or 0, i)), 1):
            state += n * done[i][5]
            numbers[i] = (n, state)
        out += [(conv, d[4], *d[:4], *numbers.get(i, (None, None))) for i, d in enumerate(done)]
    return out


def replayed(spark, rows, parts=4):
    turns = spark.createDataFrame([(c, t, "user", x, "a", "b") for c, t, x in rows], TURNS).repartition(parts)
    found = release.replay(turns).select("conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state")
    return [tuple(int(v) if k == 7 and v is not None else v for k, v in enumerate(r)) for r in found.collect()]


def test_release_is_that_of_a_replay(spark):
    """Short conversations and a long one, gaps between turns, nulls everywhere, repeated rows."""
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["a", "héllo", "", None, "x" * 50])) for c in range(25) for t in sorted(rng.sample(range(30), rng.randint(1, 9)))]
    rows += [(77, t, f"text {t}") for t in range(700)] + [(3, 2, "again"), (3, 2, "again"), (None, 1, "n"), (None, 0, None), (4, None, "x"), (4, None, "x")]
    assert sorted(replayed(spark, rows), key=str) == sorted(plain(rows), key=str)


def test_empty_table_and_one_turn(spark):
    assert replayed(spark, []) == []
    assert replayed(spark, [(1, 5, "a")]) == plain([(1, 5, "a")])


def test_a_hot_conversation_fills_no_task(spark):
    """Numbers and releases of one conversation come from ranges of it, none of which holds a large part."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(20_000).select(F.lit("=1").alias("conv"), F.col("id").alias("turn"))
    ranged = release._ranged(rows, "conv", "turn")
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) > 3 and max(sizes) < 0.4 * 20_000
    numbered = release.numbered(rows, "conv", ["turn"], "n")
    assert numbered.where("n <> turn").count() == 0 and numbered.count() == 20_000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def pieces_at(pieces: list[tuple], x: int) -> int | None:
    lo, add, moves = max((p for p in pieces if p[0] <= x), key=lambda p: p[0])
    return None if add is None else add + (x if moves else 0)


def random_pieces(rng: random.Random) -> list[tuple]:
    lows = [release._NEVER, *sorted(rng.sample(range(0, 60), rng.randint(0, 4)))]
    # only constants come before the first second
    return [(lo, rng.choice([None, rng.randint(0, 40)]) if rng.random() < 0.25 or i == 0 and rng.random() < 0.2 else rng.randint(0, 40), i > 0 and rng.random() < 0.6) for i, lo in enumerate(lows)]


def test_composition(spark):
    rng = random.Random(6)
    pairs = [(random_pieces(rng), random_pieces(rng)) for _ in range(300)]
    kind = release.PIECES
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], f"i int, f {kind}, g {kind}").withColumn("h", release.composed(F.col("f"), F.col("g")))
    for row in df.collect():
        f, g, h = ([tuple(p) for p in x] for x in (row.f, row.g, row.h))
        for x in range(-1, 120):
            once = pieces_at(f, x)
            assert pieces_at(h, x) == (None if once is None else pieces_at(g, once)), (f, g, h, x)
        assert [p[0] for p in h] == sorted({p[0] for p in h})


@pytest.mark.parametrize("shape", ["random", "chain", "star", "roots"])
def test_contraction_is_plain_evaluation(spark, shape):
    rng, n = random.Random(11), 150
    parent = {"random": lambda p: rng.choice([None, *range(max(0, p - 4), p)]), "chain": lambda p: p - 1 if p else None, "star": lambda p: 0 if p else None, "roots": lambda p: None}[shape]
    nodes = [(c, p, parent(p), [(-(1 << 62), rng.randint(0, 9), False), (0, rng.randint(0, 9), True)] if shape == "chain" and rng.random() < 0.9 else random_pieces(rng)) for c in ("a", "b") for p in range(n)]
    want: dict[tuple, int | None] = {}
    for c, p, up, pieces in nodes:
        start = release._NEVER if up is None else want[c, up]
        want[c, p] = None if start is None else pieces_at(pieces, start)
    got = release.evaluate_forest(spark.createDataFrame(nodes, NODES)).collect()
    assert {(r.conv, r.p): r.value for r in got} == want and len(got) == len(nodes)
