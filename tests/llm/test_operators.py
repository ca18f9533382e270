import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from floorline.llm import decontam, htmltext, langid, licenses, linededup, mixing, oracles, quality, sharding, topk

DOCS = "doc_id long, text string"


def same_as_sql(spark_df, sql, **tables):
    con = duckdb.connect()
    for name, pdf in tables.items():
        con.register(name, pdf)
    want = con.sql(sql).df()
    got = spark_df.toPandas()[list(want.columns)]
    key = lambda df: sorted((tuple("-" if v is None or v != v else f"{float(v):.9f}" if isinstance(v, (int, float, np.number, np.bool_)) else str(v) for v in r) for r in df.itertuples(index=False, name=None)))
    assert key(got) == key(want)


# --- licences ---


def wrapped(text, width):
    import textwrap

    return "\n".join(textwrap.wrap(text, width))


def plain_licenses(text, threshold=0.8):
    """Each template's best window, without those that a better one overlaps."""
    grams = lambda words: list(zip(words, words[1:])) if len(words) > 1 else [tuple(words)] if words else []
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    g, found = grams(split(text)), []
    for t, (name, body) in enumerate(licenses.TEMPLATES):
        own, width = set(grams(split(body))), max(1, len(split(body)) - 1)
        tried = [(2 * len(own & set(g[p : p + width])) / (len(own) + len(set(g[p : p + width]))), -p) for p in range(len(g)) if g[p] in own]
        if tried and max(tried)[0] >= threshold:
            found.append((*max(tried), t, name, width))
    apart = lambda x, y: -y[1] > -x[1] + x[4] or -x[1] > -y[1] + y[4]
    return [(1 - x[1], x[3], round(x[0], 9)) for x in found if all(apart(x, y) or (y[0], -y[2]) <= (x[0], -x[2]) for y in found)]


MIT, GPL = licenses.TEMPLATES[2][1], licenses.TEMPLATES[6][1]
LICENSED = [
    "Intro line.\nReleased under the MIT License.\nmore\nThis work is licensed under GNU General Public License, version 3!",
    "all RIGHTS   reserved", None, "", "nothing to see", "Licensed under CC BY-NC 4.0.", "Rights",
    MIT.replace(", ", ",\n"), (MIT.replace(", ", ",\n") + "\n") * 12,  # the same lines twelve times over
    "filler words of prose " * 3_000 + wrapped(MIT, 72) + " and more prose" * 3_000,
    "A long line of prose, released under the MIT License, goes on and on " + "for a while " * 200 + wrapped(GPL, 60),
    wrapped("Copyright me.\n" + MIT + " The above copyright notice shall be included in all copies.", 76), "word " * 50_000, "the of and to " * 20_000,
    licenses.TEMPLATES[16][1],
]


def test_licenses(spark):
    rows = [*enumerate(LICENSED), (5, LICENSED[5]), (None, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, DOCS)
    clash = df.withColumn("line", F.lit(0)).withColumn("dice", F.lit(0)).withColumn("grams.x", F.lit(0)).withColumn("known", F.lit(0))
    got = Counter((r.doc_id, r.word, r.license, round(r.dice, 9)) for r in licenses.scan_licenses(clash).collect())
    assert got == Counter((d, *x) for d, t in rows for x in plain_licenses(t))
    names = {d: {r[2] for r in got if r[0] == d} for d, _ in rows}
    assert names[0] == {"MIT", "GPL-3.0"} and names[7] == names[8] == names[9] == names[11] == {"MIT"} and names[10] == {"MIT", "GPL-3.0"} and names[14] == {"AGPL-3.0"}
    assert not any(names[d] for d in (2, 3, 4, 6, 12, 13))
    same_as_sql(licenses.scan_licenses(df), oracles.license_scan(), documents=df.toPandas())
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        licenses.template_column([("x", "a " * 300_000)], 0.8)


# --- decontamination ---

ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "Short, question?"), (10, "short QUESTION"), (3, None), (4, ""), (None, "one two three four five six seven eight nine ten")]
BENCH = "item_id long, text string"
TEXTS = [(1, "xx one TWO, three-four five six seven; eight nine ten eleven yy"), (2, "one two three four five six seven eight nine"), (3, None), (4, ""), (5, "a short question and a short answer: short question"), (5, "a short question and a short answer: short question"), (6, "shorts question"), (7, "Übung straße short — question é"), (8, "filler " * 60_000 + "short question")]


def plain_scan(text, items):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words_of = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(low))
    words, hit, found = words_of(text), set(), set()
    for item, body in items:
        w = words_of(body) if item is not None else []
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(words), len(hit), sorted(found, key=str)


def test_decontamination(spark):
    docs, items = spark.createDataFrame(TEXTS, DOCS).withColumn("n_hit", F.lit(0)), spark.createDataFrame(ITEMS, BENCH)
    got = sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontam.find_contamination(docs, items).collect())
    assert got == sorted((d, n, h, tuple(f)) for d, t in TEXTS for n, h, f in [plain_scan(t, ITEMS)])
    spans = {r.doc_id: [TEXTS_BY[r.doc_id][x.start : x.end] for x in r.spans] for r in decontam.find_contamination(docs, items).collect()}
    assert spans[1] == ["one TWO, three-four five six seven; eight nine ten eleven"] and spans[5] == ["short question"] * 2 and spans[8] == ["short question"]
    assert not any(spans[d] for d in (2, 3, 4, 6, 7))  # in 7 a dash that is no ASCII stands between as a word of its own
    text = "Ünï — é! short\tQUESTION… ¿Short; question? SHORT (question) one Two three four five, six seven eight nine ten"
    row = decontam.find_contamination(spark.createDataFrame([(1, text)], DOCS), items).first()
    assert [text[x.start : x.end] for x in row.spans] == ["SHORT (question) one Two three four five, six seven eight nine ten"]
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, t in TEXTS if not plain_scan(t, ITEMS)[1])
    empty = spark.createDataFrame([], DOCS)
    assert decontam.find_contamination(empty, items).count() == 0
    assert decontam.drop_contaminated(docs, spark.createDataFrame([], BENCH)).count() == len(TEXTS)


TEXTS_BY = dict(TEXTS)


def test_decontamination_in_slices(spark):
    items = spark.createDataFrame(ITEMS, BENCH)
    assert len(decontam.item_slices(items, "item_id", "text", budget=10)) > 1
    lists = [s.value for s in decontam.item_slices(items, "item_id", "text", budget=10)]
    for _, t in TEXTS:
        n, marks, found = decontam.scan(t, lists, 10)
        assert (n, 0 if marks is None else int(marks.sum()), sorted(found, key=str)) == plain_scan(t, ITEMS)


def test_each_automaton_is_built_once_a_turn(monkeypatch):
    import pyarrow as pa

    built = []
    monkeypatch.setattr(decontam.Scanner, "_built", {})
    monkeypatch.setattr(decontam.Scanner, "__init__", lambda self, items, window: built.append(len(items)) or self.__dict__.update(empty=True))
    for n, most in ((2, 2), (5, 5)):  # as many as are kept; more of them, and all text in one turn
        slices, batches = [decontam.slice_of([(i, f"item {i}")]) for i in range(n)], [pa.RecordBatch.from_arrays([pa.array(["a b"])], names=["text"])] * 4
        built.clear()
        decontam.Scanner._built.clear()
        turns = list(decontam._turns(iter(batches), 0, n))
        for batch in turns:
            decontam.scan_all(batch.column(0).to_pylist(), slices, 10)
        assert sum(b.num_rows for b in turns) == 4 and len(built) == most


def test_memory_of_an_automaton():
    import subprocess
    import sys

    code = "import resource as r, random; from floorline.llm import decontam as d; a = r.getrusage(r.RUSAGE_SELF).ru_maxrss; w = lambda: ''.join(random.choices('abcdefghij', k=5)); d.Scanner([(i, ' '.join(w() for _ in range(60))) for i in range(d.AUTOMATON_BYTES // 360)], 10); print((r.getrusage(r.RUSAGE_SELF).ru_maxrss - a) // 1024)"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 400


# --- mixing ---


def water(sizes, weights, most):
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / total for s in free}
        target |= {s: most * sizes[s] for s in over}
        left, free = left - sum(most * sizes[s] for s in over), free - over
    return target


def plain_mix(rows, weights=(1, 2, 3), most=3, seed=17, liking=None):
    """[(source, size, expected, copies)] by Pareto order sampling, row by row; whole numbers and MD5 make the dice."""
    import hashlib
    from fractions import Fraction

    size = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, _ in rows]
    like = [1000 * n // (n + 100) if liking is None else liking[i] for i, n in enumerate(size)]
    total = Counter()
    for n, (_, _, s) in zip(size, rows):
        total[s] += n
    order = sorted(s for s in total if s is not None) + ([None] if None in total else [])
    target = water(dict(total), {s: weights[i % len(weights)] for i, s in enumerate(order)}, most) if sum(total.values()) else dict.fromkeys(total, 0.0)
    out = [None] * len(rows)
    for s in order:
        own = [i for i, r in enumerate(rows) if r[2] == s]
        ratio = target[s] / total[s] if total[s] else 0.0
        mean = sum(size[i] * like[i] for i in own) / total[s] if total[s] else 0.0
        ranked, lack = [], target[s]
        for i in own:
            due = max(0.0, min(float(most), ratio + max(0.0, min(ratio, most - ratio)) * (like[i] - mean) / 1000.0))
            whole = int(due // 1)
            part = due - whole
            dice = int(hashlib.md5(f"{seed}:{'null' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest()[:13], 16) / 2**52
            rank = dice * (1 - part) / (dice * (1 - part) + (1 - dice) * part) if part > 0 else 1.0
            ranked.append((rank, (rows[i][0] is not None, rows[i][0] or 0), size[i], i, part))
            lack -= whole * size[i]
            out[i] = [s, size[i], due, whole]
        before = 0
        for _, _, n, i, part in sorted(ranked):
            if part > 0:
                out[i][3] += before + n / 2 <= lack
                before += n
    return out


MIXED = "doc_id long, text string, source string"


def mixable(n=3000):
    rng = np.random.default_rng(0)
    return [(i, "w " * int(rng.integers(1, 60) ** 1.5), ["hot", "hot", "hot", "a", "b", None, "tiny"][int(rng.integers(0, 7))] if i % 50 else "tiny2") for i in range(n)]


def test_mixing_is_pareto_order_sampling(spark):
    rows = mixable()
    df, want = spark.createDataFrame(rows, MIXED), plain_mix(rows)
    got = mixing.mix(df).collect()
    assert sorted((r.doc_id, r.source or "", r.size, r.copies) for r in got) == sorted((r[0], w[0] or "", w[1], w[3]) for r, w in zip(rows, want))
    by_source = {}
    for (_, _, s), w in zip(rows, want):
        by_source.setdefault(s, []).append(w)
    targets = {r.source: r.target for r in got}
    for s, own in by_source.items():
        assert sum(w[1] * w[2] for w in own) == pytest.approx(targets[s])  # what is expected is the target
        assert abs(sum(w[1] * w[3] for w in own) - targets[s]) <= max(w[1] for w in own) / 2 + 1
    odds = {round(w[2] % 1, 6) for w in by_source["hot"]}
    assert len(odds) > 50  # documents of one source differ in their odds
    long_, short = ([w for w in by_source["hot"] if on(w[1])] for on in (lambda n: n > 200, lambda n: n < 50))
    assert np.mean([w[3] for w in long_]) > np.mean([w[3] for w in short])
    assert all(r.taken == r.size * r.copies and 0 <= r.copies <= 3 for r in got)
    for most in (0, 100):
        again = mixing.mix(df.repartition(7), broadcast_sources=most).collect()
        assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    same_as_sql(mixing.mix(df).drop("source"), oracles.source_mix(), documents=df.toPandas())


def test_mixing_by_a_column(spark):
    rows = mixable(600)
    liking = [(i * 37) % 1001 for i in range(len(rows))]
    df = spark.createDataFrame([(*r, k) for r, k in zip(rows, liking)], MIXED + ", liking int")
    want = plain_mix(rows, liking=liking)
    assert sorted((r.doc_id, r.copies) for r in mixing.mix(df, propensity="liking").collect()) == sorted((r[0], w[3]) for r, w in zip(rows, want))
    whole = mixing.mixed_rows(df, propensity="liking").groupBy("doc_id").count().collect()
    assert Counter({r.doc_id: r["count"] for r in whole}) == +Counter({r[0]: w[3] for r, w in zip(rows, want)})


@pytest.mark.parametrize("most", [50_000, 0])
def test_mixed_rows_are_the_mix(spark, most):
    rows = mixable(1500) + [(7, "again and again", "hot")] * 400 + [(None, "no id at all", "a")] * 30 + [(9999, None, None), (9998, "", "b")]
    df = spark.createDataFrame(rows, MIXED)
    want = Counter()
    for r, w in zip(rows, plain_mix(rows)):
        want[r] += w[3]
    clash = df.withColumn("size", F.lit("x")).withColumn("_bin", F.lit("y")).withColumn("copies", F.lit(-1)).withColumn("a.b", F.lit(1)).withColumn("_row", F.lit(2))
    got = mixing.mixed_rows(clash.repartition(5), broadcast_sources=most)
    assert got.columns == clash.columns
    assert Counter((r.doc_id, r.text, r.source) for r in got.collect()) == +want
    assert mixing.mixed_rows(clash.limit(0)).columns == clash.columns and mixing.mixed_rows(clash.limit(0)).count() == 0


def test_mixing_moves_no_text(spark):
    plan = mixing.mixed_rows(spark.createDataFrame(mixable(50), MIXED))._jdf.queryExecution().executedPlan().toString()
    assert "_row" in plan
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in moved if "_row" in line and "_times" not in line and "count" not in line and "_ties" not in line]


def test_mixing_edges(spark):
    empty = spark.createDataFrame([], MIXED)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, "", "a")], MIXED)
    assert [r.taken for r in mixing.mix(none).collect()] == [0, 0] and mixing.mixed_rows(none).count() == 0
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s"), (2, "x " * 90_000, "t")], MIXED).withColumn("target", F.lit(7)).withColumn("_bin", F.lit(1))
    assert mixing.mix(df).count() == 4


# --- sharding ---


@pytest.mark.parametrize("n, block", [(0, 100), (5, 100), (500, 100), (3000, 7)])
def test_sharding(spark, n, block):
    rows = [(i, "copy" if i % 3 == 0 else f"pair {i // 2}" if i % 5 == 0 else None if i % 97 == 0 else "" if i % 89 == 0 else f"text ü {i}") for i in range(n)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, DOCS).withColumn("grp", F.lit("e")).withColumn("slot", F.lit("clash"))
    got = sharding.shard(df, block=block).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    text = dict(rows)
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got)
    counts = Counter(r.shard for r in got)
    if n:
        sizes = [counts[s] for s in range(24)]
        assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(counts[s])) for s in counts)
    full = sharding.shard(df.withColumn("a.b", F.lit(3)), block=block, carry=True)
    assert full.columns == ["doc_id", "text", "grp", "a.b", "size", "text_crc32", "shard", "slot"]
    whole = full.collect()
    assert sorted((r.shard, r.slot, r.doc_id, r.size) for r in whole) == sorted((r.shard, r.slot, r.doc_id, r.size) for r in got)
    assert Counter((r.doc_id, r.text) for r in whole) == Counter(rows)


def where_groups_are(rows, got):
    where = {}
    for d, t in rows:
        where.setdefault(t, Counter())[got[d]] += 1
    return where


def test_groups_stay_together(spark):
    rows = [(i, f"group {i % 200}") for i in range(1000)] + [(1000 + i, "hot") for i in range(900)] + [(2000 + i, f"alone {i}") for i in range(500)]
    full = sharding.shard(spark.createDataFrame(rows, DOCS), carry=True)
    where = where_groups_are(rows, {r.doc_id: r.shard for r in full.collect()})
    assert not [g for g in range(200) if len(where[f"group {g}"]) > 1]
    assert len(where["hot"]) <= 12  # nine shards' worth of one text, in blocks of a quarter of a shard
    links = sum(sum(c.values()) * (sum(c.values()) - 1) // 2 for c in where.values())
    kept = sum(n * (n - 1) // 2 for c in where.values() for n in c.values())
    assert sharding.links_cut(full) == (links, links - kept)


def test_settling_goes_on_until_no_block_is_left(spark):
    """Many groups that all want the same few shards: more than a dozen rounds would be needed by those that come last."""
    n, shards = 400, 40
    blocks = spark.createDataFrame([(g, 0, g % 2, 9) for g in range(n)], "grp long, block long, shard int, n long")
    homes = sharding._settle(blocks, [90] * shards, shards).collect()
    assert len(homes) == n and max(Counter(r.home for r in homes).values()) <= 10


def test_blocks_move_to_their_kin(spark):
    rows = [(g, b, 10, (g + b) % 6) for g in range(8) for b in range(4)] + [(99, 0, 10, 0)]
    settled = spark.createDataFrame(rows, "grp long, block long, size long, home int")
    loads = Counter(r[3] for r in rows)
    room = [80 - 10 * loads[s] for s in range(6)]
    after = sharding._propagate(settled, room, 6).collect()
    assert Counter((r.grp, r.block) for r in after) == Counter((r[0], r[1]) for r in rows)
    assert max(Counter(r.home for r in after).values()) <= 8

    def crossing(found):
        return sum(a[0] == b[0] and a[1] != b[1] for i, a in enumerate(found) for b in found[:i])

    before, now = crossing([(r[0], r[3]) for r in rows]), crossing([(r.grp, r.home) for r in after])
    assert now < before / 2
    assert sorted(map(tuple, sharding._propagate(settled, [0] * 6, 6).collect())) == sorted((g, b, s, h) for g, b, s, h in rows)


def test_a_row_repeated_without_end(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LISTED", 50)
    rows = [(1, "same")] * 700 + [(None, None)] * 300 + [(i, f"t{i}") for i in range(200)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS), carry=True).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows) and set(Counter(r.shard for r in got).values()) == {50}


# --- top k ---


def plain_top(rows, k):
    good = [(i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in {(q, tuple(a)) for q, a in good if q % 20 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(1000 + i, [0.5] * 8) for i in range(40)] + [(2000, None), (2020, [1.0, None] + [0.0] * 6), (2040, [float("nan")] * 8), (2060, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (2080, [1.0, 2.0]), (2100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    for shard, block in ((8192, 1024), (37, 5)):
        got = topk.top_k(df, F.col("id") % 20 == 0, shard_rows=shard, block_rows=block)
        assert {tuple(r) for r in got.collect()} == plain_top(rows, 20)
    few = [(0, [1.0]), (1, [2.0]), (2, [2.0])]
    assert {tuple(r) for r in topk.top_k(spark.createDataFrame(few, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).collect()} == {(0, 1, 1, 8192), (0, 2, 2, 8192)}
    assert topk.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def made_groups(n=16, each=200, dim=4):
    rng = np.random.default_rng(0)
    return np.concatenate([(c + rng.normal(size=(each, dim))).astype(np.int64) for c in rng.normal(size=(n, dim)) * 1000])


def test_bounds_prune():
    rows = made_groups()
    tree = topk.Tree(np.arange(len(rows)), rows, leaf=50)
    inner = [i for i, m in enumerate(tree.members) if m is None]
    assert len(inner) > 20 and sum(len(m) for m in tree.members if m is not None) == len(rows)
    for i in inner:  # boxes are those of the vectors below
        assert (tree.low[i] == np.minimum(*tree.low[list(tree.children[i])])).all() and (tree.high[i] == np.maximum(*tree.high[list(tree.children[i])])).all()
    queries = rows[::400]
    best = topk.Best(len(queries), 5)
    assert topk.search(tree, np.full(len(queries), -1), queries, best) > 0.8 * len(queries) * len(rows)
    want = np.sort(queries @ rows.T, axis=1)[:, ::-1][:, :5]
    assert (best.scores == want).all()
    known = topk.Best(len(queries), 5, want[:, -1] + 1)  # a floor from elsewhere that only better ones pass
    topk.search(tree, np.full(len(queries), -1), queries, known)
    assert (np.where(known.scores > np.iinfo(np.int64).min, known.scores, want[:, -1:] + 1) > want[:, -1:]).all()


def test_few_queries_go_on_to_another_shard(spark):
    """With structure the boxes of shards prune: what travels in the second pass is a small part of all queries times shards."""
    rows = made_groups()
    nodes = topk.median_splits(rows, 16)
    dealt = topk.shard_of(rows, nodes)
    assert len(nodes) == 15 and Counter(dealt.tolist()).keys() == set(range(16)) and max(Counter(dealt.tolist()).values()) <= 250
    low, high = (np.stack([f(rows[dealt == s], axis=0) for s in range(16)]) for f in (np.min, np.max))
    queries = rows[::20]
    reach = topk.bounds(queries, low, high)
    kth = np.array([np.sort(rows[dealt == reach[i].argmax()] @ q)[-20] for i, q in enumerate(queries)])
    assert (reach >= kth[:, None]).sum() < 0.35 * reach.size
    df = spark.createDataFrame([(i, (v / 64).tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("id") % 20 == 0, shard_rows=200, block_rows=16)
    assert {(r.query_id, r["rank"], r.score) for r in got.collect()} == {(int(i), n + 1, int(s)) for i in range(0, len(rows), 20) for n, s in enumerate(np.sort(np.delete(rows @ rows[i], i))[::-1][:20])}


def test_one_vector_for_a_third_of_all(spark):
    rows = [(i, [1.0, 2.0] if i % 3 else [float(i % 7), float(i % 11)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("a.b", F.lit(1)).withColumn("id", F.lit("x")).withColumn("vec", F.lit("y"))
    assert {tuple(r) for r in topk.top_k(df, F.col("id") % 20 == 0, shard_rows=50, block_rows=8).collect()} == plain_top(rows, 20)


# --- pages ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a<b) "</p>"</script></head><body><header>Site name</header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article class="post reader"><header><h1>Title &amp; more</h1></header><p>First <b>bold
text<p>Second&nbsp;para.<br>New line</p><aside>Related stuff</aside><div class=ad>Buy now</div><ul><li>one<li>two</ul><pre>x  y</pre>
<form>Name <input></form><section id="comments"><article class="comment">I disagree</article></section><!-- hidden --></article></main><div id="sidebar">Links</div><footer>&copy; me</footer></body>"""


def test_html():
    assert htmltext.extract_text(PAGE) == "Title & more\n\nFirst bold text\n\nSecond para. New line\n\none\n\ntwo\n\nx y"
    assert htmltext.extract_text(None) == htmltext.extract_text("") == htmltext.extract_text("<nav>x</nav>") == ""
    assert htmltext.extract_text("plain words") == "plain words"
    assert htmltext.extract_text("<p>a<![x") in ("a", "a<![x")
    bare = "<body><div><a href=1>Home</a> <a href=2>News</a></div>" + "<p>A long paragraph of the story that goes on and on for a while.</p>" * 6 + "<div><a href=3>Imprint</a></div>"
    assert htmltext.extract_text(bare) == "\n\n".join(["A long paragraph of the story that goes on and on for a while."] * 6)


@pytest.mark.parametrize("broken", ["<![ endif]-->", "<![foo[x]]>", "<![>", "<![if !IE]>", "<![CDATA>", "<!x>", "<!>"])
def test_html_goes_on_after_a_broken_declaration(broken):
    text = htmltext.extract_text(f"<p>one</p>{broken}<p>two</p><p>three</p>")
    assert text.startswith("one") and text.endswith("two\n\nthree")


@pytest.mark.parametrize("huge, many, each", [(20_000, 10, 300), (3_000, 10, 200), (200_000, 30, 40)])
def test_html_keeps_paragraphs_beside_a_huge_one(huge, many, each):
    paragraphs = ["h" * huge, *(f"{i} " + "p" * each for i in range(many))]
    menu = "<div><a href=1>Home</a> <a href=2>News</a></div>"
    for order in (paragraphs, paragraphs[::-1]):
        page = menu + "<div>" + "".join(f"<p>{p}</p>" for p in order) + "</div>" + menu
        assert htmltext.extract_text(page) == "\n\n".join(order)


def made_page(rng, article):
    """A page and its main text, blocks of it known as they are written; what is set aside is marked in one way or another."""
    word = lambda: "".join(rng.choice(list("abcdeéß"), rng.integers(1, 9)))
    words = lambda low, high: " ".join(word() for _ in range(rng.integers(low, high)))
    pick = lambda *x: x[rng.integers(len(x))]
    links = lambda: "".join(f"<li><a href='/{word()}'>{words(1, 3)}</a></li>" for _ in range(rng.integers(3, 8)))
    text, main = [], []

    def block():
        kind = pick("p", "p", "p", "p", "h2", "list", "quote", "inline", "open", "ref")
        if kind == "list":
            items = [words(4, 30) for _ in range(rng.integers(1, 4))]
            main.extend(items)
            return "<ul>" + "".join(f"<li>{x}" + pick("", "</li>") for x in items) + "</ul>"
        t = words(20, 120) if kind != "h2" else words(1, 5)
        main.append(t)
        if kind == "ref":
            main[-1] = f"{t} & < {word()}"
            main[-1] = main[-1] if not main[-1].endswith(" ") else main[-1].strip()
            return "<p>" + main[-1].replace("&", "&amp;").replace("<", "&lt;") + "</p>"
        if kind == "inline":
            a, b = t.split(" ", 1)
            return f"<p><b>{a}</b>\n  <i class=x>{b}</i></p>"
        return {"p": f"<p>{t}</p>", "h2": f"<h2>{t}</h2>", "quote": f"<blockquote><p>{t}</p></blockquote>", "open": f"<p>{t}"}[kind]

    aside = lambda: pick(f"<nav><ul>{links()}</ul></nav>", f"<div class='sidebar-{word()}'><p>{words(5, 60)}</p></div>", f"<aside>{words(3, 40)}</aside>", f"<div id=comments><p>{words(5, 50)}</p></div>", f"<form>{words(1, 4)}<input name=x><button>{words(1, 2)}</button></form>", f"<div class='ad'>{words(3, 30)}</div>", f"<script>var a = '</p> {words(3, 9)}';</script>", f"<style>{words(1, 5)}</style>", f"<!-- {words(3, 30)} -->", f"<div role=alert>{words(3, 20)}</div>", f"<![if x]>")
    body = "".join(block() + (aside() if rng.random() < 0.2 else "") for _ in range(rng.integers(3, 12)))
    body = f"<article>{body}</article>" if article else f"<div class=text>{body}</div>"
    return f"<html><head><title>{words(1, 5)}</title></head><body><header>{words(1, 5)}</header>" + aside() + body + aside() + f"<footer>{words(2, 9)}</footer></body></html>", "\n\n".join(main)


@pytest.mark.parametrize("article", [True, False])
def test_html_of_made_pages(article):
    rng = np.random.default_rng(article)
    pages = [made_page(rng, article) for _ in range(300)]
    got = [htmltext.extract_text(page) for page, _ in pages]
    wrong = [i for i, (_, text) in enumerate(pages) if got[i] != text]
    assert not wrong, (pages[wrong[0]], got[wrong[0]])


def test_ratio_smoothing_and_threshold_decide(monkeypatch):
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()
    plain = [htmltext.extract_text(p) for p in pages]
    story, menu = "<div>" + "<p>A long paragraph of the story that goes on and on for a while, and on.</p>" * 6 + "</div>", "<nav>" + "<p>Item</p>" * 6 + "</nav>"
    far, beside = menu + "<div><b>Ok</b></div>" + menu + story + menu, menu + story + "<div><b>Ok</b></div>" + menu
    assert "Ok" not in htmltext.extract_text(far) and "Ok" in htmltext.extract_text(far, level=0.05)  # the threshold
    assert "Ok" in htmltext.extract_text(beside) and "Ok" not in htmltext.extract_text(beside, sigma=1e-3)  # the smoothing
    monkeypatch.setattr(htmltext, "ratio", lambda line: 1.0)
    assert all(htmltext.extract_text(p) != t for p, t in zip(pages, plain))


def test_a_teaser_is_not_the_article():
    story = "<div id=story>" + "<p>A long paragraph of the story that goes on and on for a while, and then on.</p>" * 5 + "</div>"
    text = htmltext.extract_text("<article><p>Short <b>teaser</b> <i>of</i> <b>it</b></p></article>" + story + "<div><p>Note</p></div>")
    assert text.count("A long paragraph") == 5 and "Note" not in text


@pytest.mark.parametrize("page", ["<div>" + "<i>" * 30_000 + "</b>" * 30_000, "<b><div>" + "<i>" * 30_000 + "</b>" * 30_000, "<p>" * 60_000, "<div>" * 30_000 + "x" + "</div>" * 30_000, "</p>" * 60_000, "<li><a>" * 30_000])
def test_html_takes_linear_time(page):
    import time

    start = time.perf_counter()
    htmltext.extract_text(page + "end")
    assert time.perf_counter() - start < 10


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<article><p>é</p></article>")], "page_id long, url string, html string").withColumn("text", F.lit(0))
    got = sorted(((r.page_id, r.text[:5]) for r in htmltext.extract(df).collect()), key=str)
    assert got == sorted([(1, "Title"), (1, "Title"), (2, ""), (None, "é")], key=str)
    assert htmltext.extract(df.limit(0)).count() == 0


def test_lines_and_hosts(spark):
    pages = ["<p>if a < b then stop and c > d go &amp; end</p>", "<!DOCTYPE html><p class=x>one<br/>two &lt;b&gt; &amp;lt; three</p><!-- no --><script>x</script><preface>kept</preface>", None, "a<b>c</b>"]
    rows = [r[0] for r in spark.createDataFrame([(p,) for p in pages], "html string").select(linededup.lines_of(F.col("html"))).collect()]
    assert rows == [["if a < b then stop and c > d go & end"], ["one", "two <b> &lt; three", "kept"], [], ["ac"]]
    urls = {"http://u:p@H.example/x": "h.example", "https://a@b.example:80": "b.example", "http://h.example/a@b": "h.example", "http://[::1]:8/": "[::1]", "h.example": "", None: ""}
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(linededup.host_of(F.col("url"))).collect()
    assert [r[0] for r in got] == list(urls.values())


@pytest.mark.parametrize("lines", [200_000, 0])
def test_line_dedup(spark, lines):
    page = lambda i: f"<ul><li>Menu</li><li>Own {i}</li></ul><p>Foot &amp; note</p>" + ("<p>Rare</p>" if i < 2 else "")
    rows = [(i, f"http://Big.example/{i}?q", page(i)) for i in range(20)] + [(i, f"https://small.example:80/{i}", page(i)) for i in range(2)] + [(50, None, "<p>Menu</p>"), (51, "nonsense", None), (52, "http://big.example/52", ""), (0, "http://big.example/0?q", page(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = linededup.drop_boilerplate(df.withColumn("host", F.lit("x")).withColumn("text", F.lit("y")).withColumn("a.b", F.lit("z")), broadcast_lines=lines)
    got = {(r.page_id, r.host): (r.n_lines, r.n_dropped, r.text) for r in out.collect()}
    assert got[3, "big.example"] == (3, 2, "Own 3") and got[1, "big.example"] == (4, 2, "Own 1\nRare")
    assert got[1, "small.example"][1] == 0 and got[50, ""] == (1, 0, "Menu") and got[51, ""] == (0, 0, "") and got[52, "big.example"] == (0, 0, "")
    assert out.count() == len(rows)
    same_as_sql(linededup.drop_boilerplate(df), oracles.line_dedup(), pages=df.toPandas())
    assert linededup.drop_boilerplate(df.limit(0)).count() == 0


# --- classifiers ---


def held(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return docs, labels


def test_quality_on_held_out(spark, corpus):
    docs, labels = corpus
    model = quality.fit(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    scored = quality.score_quality(docs, model).join(labels, "doc_id").collect()
    test = [r for r in scored if held(r.doc_id, 5) == 0]
    good, bad = [r.score for r in test if r.quality == 1], [r.score for r in test if r.quality == 0]
    rank = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert rank > 0.98 and np.mean([g >= quality.CUTOFF for g in good]) > 0.97 and np.mean([b >= quality.CUTOFF for b in bad]) < 0.15
    texts = [r.text for r in docs.limit(200).collect()]
    by_difference = np.argsort([model.difference(t) for t in texts], kind="stable")
    scores = np.array([model.score(t) for t in texts])[by_difference]
    assert (np.diff(scores) >= 0).all() and len(set(scores)) > 100  # the difference alone decides


def test_manner_of_words():
    assert quality.manner("One one, ONE!! one\n12 one") == bytes([128 + 40 + 3]) + bytes([128 + 3]) + b"," + bytes([128 + 20 + 3]) + b"!!" + bytes([128 + 3]) + b"\n" + bytes([128 + 60 + 2]) + bytes([128 + 3]) + b"\n"
    assert quality.manner("go go on go\ngo") == bytes([130, 140, 130, 140]) + b"\n" + bytes([130]) + b"\n"
    assert quality.manner(None) == quality.manner("") == b"\n"
    long_ = "some words here " * 100_000
    assert len(quality.manner(long_)) > 100_000


def test_quality_edges(spark):
    model = quality.fit_texts(["good words here"] * 5, [])
    assert 0 < model.score(None) == model.score("") < 1
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "x " * 200_000)], DOCS).withColumn("score", F.lit("s"))
    assert quality.score_quality(docs, model).count() == 4 and quality.keep_good(docs, model).columns == docs.columns
    assert quality.keep_good(docs, model).count() == 4
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, empty, F.lit(True)).score("x") == pytest.approx(0.5)
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_language_on_held_out(spark, corpus):
    docs, _ = corpus
    model = langid.fit(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in found if held(r.doc_id, 4) == 2]
    assert np.mean([r.lang_pred == r.lang for r in test]) > 0.99 and all(0 <= r.score <= 1 for r in found)


def test_long_texts_have_the_grams_of_whole_ones(monkeypatch):
    raw = bytes(np.random.default_rng(0).integers(97, 123, 1000, dtype=np.uint8))
    whole = np.sort(np.concatenate(list(langid._grams(raw))))
    assert len(whole) == 1001 + 1000
    for piece in (1, 7, 999, 1000, 1001, 1002):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert (np.sort(np.concatenate(list(langid._grams(raw)))) == whole).all()


def test_language_sample_is_bounded(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else "de") for i in range(4000)] + [(7, "again " * 5, "en")] * 300 + [(None, "no id", "en")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("at", F.lit(0)).withColumn("a.b", F.lit(0))
    got = langid.sample(df, F.lit(True), rows=200)
    assert set(got) == {"de", "en"} and all(100 <= len(v) <= 200 and len(set(v)) == len(v) for v in got.values())


def test_language_edges(spark):
    model = langid.fit_texts({"en": ["the cat and the dog"] * 3, "de": ["der hund und die katze"] * 3})
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? ½²"), (4, "THE DOG"), (4, "THE DOG"), (None, "die katze " * 40_000)], DOCS).withColumn("lang_pred", F.lit(1))
    got = sorted(((r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect()), key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de")], key=str)
    assert langid.fit_texts({}).predict("x")[0] == "und" and langid.fit_texts({"en": ["a"]}).predict("x")[0] == "en"
    assert langid.identify(docs.limit(0), model).count() == 0
    for n in range(2, 12):
        code = langid.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n < 3 else 2)
