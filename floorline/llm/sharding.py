"""Balanced label propagation: linked documents move to their neighbours' shards under quotas; DataFrame functions only.

Documents with equal texts are linked. A group of copies is a clique, so how many neighbours a document has in a shard
follows from counts by group and shard, and no pair is ever listed. Groups larger than a fraction of a shard are cut
into blocks first; blocks then seek the shards that hold their group, and go on moving to where more of it is until no
block can move. Each such move makes fewer links cross shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, running_total

SHARDS = 24
#: Rows of a block at most; also at most a quarter of a shard.
BLOCK = 10_000
#: Parts into which a group's rows are dealt where they meet its size, so that a large group fills no task.
SALTS = 16
#: Equal rows that are listed by one task.
LISTED = 4096


#: Columns that are new.
NEW = ["size", "text_crc32", "shard", "slot"]


def _lookup(values: list[int], at: Column) -> Column:
    """``values[at]``: one number for each shard, so bounded by their count."""
    return F.element_at(F.array(*(F.lit(int(v)) for v in values)), (at + 1).cast("int")).cast("long")


def _loads(rows: DataFrame, shards: int, column: str = "shard", n: Column | None = None) -> list[int]:
    found = dict(rows.groupBy(column).agg(F.sum(F.lit(1) if n is None else n)).collect())
    return [int(found.get(s) or 0) for s in range(shards)]


def _heard(asks: DataFrame, room: list[int], *more: str) -> DataFrame:
    """Of ``asks`` (grp, block, size, home, and ``more``) those that shards accept: large blocks first, else in a fixed order, while there is room."""
    asks = asks.withColumn("_turn", F.pmod(F.xxhash64("grp", "block"), F.lit(1 << 40))).withColumn("_bin", (F.lit(64) - F.least(F.floor(F.log2("size")), F.lit(64))) * 64 + F.shiftright("_turn", 34))
    heard = running_total(asks.select("grp", "block", "size", "home", *more, "_turn", "_bin"), ["home"], "_bin", ["_turn", "grp", "block"], F.col("size"), "_before")
    return cut(heard.where(F.col("_before") + F.col("size") <= _lookup(room, F.col("home"))).select("grp", "block", "size", "home", *more))


def _propagate(settled: DataFrame, room: list[int], shards: int) -> DataFrame:
    """Rounds of moves of ``settled`` (grp, block, size, home) blocks to a shard that holds more of their group, until none moves.

    A block asks for the shard with most of its group among those that have room for it and hold more than its own does, or as
    much under a lower number. A round that wouldn't keep more links within shards isn't made, so rounds come to an end. Room
    that moves leave behind is there for the next one.
    """
    best = 0
    while True:
        kin = settled.groupBy("grp", "home").agg(F.sum("size").alias("kin"))
        # where each group is: as many entries as shards at most
        spots = cut(kin.groupBy("grp").agg(F.collect_list(F.struct("kin", (-F.col("home")).alias("minus"))).alias("spots"), F.sum(F.col("kin") * F.col("kin")).alias("within")))
        kept, split = spots.agg(F.sum("within"), F.count_if(F.size("spots") > 1)).first()
        if best and kept <= best:  # the round before didn't help
            return before
        if not split:
            return settled
        best, before, spots = kept, settled, spots.where(F.size("spots") > 1)
        own = F.struct(F.element_at(F.filter("spots", lambda x: x["minus"] == -F.col("was")), 1)["kin"].alias("kin"), (-F.col("was")).alias("minus"))
        fits = F.filter("spots", lambda x: (_lookup(room, -x["minus"]) >= F.col("size")) & (x > own))
        asks = settled.withColumnRenamed("home", "was").join(spots.select("grp", "spots"), "grp").withColumn("home", (-F.array_max(fits)["minus"]).cast("int")).where("home is not null")
        moved = _heard(asks, room, "was")
        gained, lost = _loads(moved, shards, "home", F.col("size")), _loads(moved, shards, "was", F.col("size"))
        if not sum(gained):
            return settled
        new = moved.select("grp", "block", F.col("home").alias("new"))
        settled = cut(settled.join(new, ["grp", "block"], "left").select("grp", "block", "size", F.coalesce("new", "home").alias("home")))
        room = [r - g + l for r, g, l in zip(room, gained, lost, strict=True)]


def _settle(blocks: DataFrame, capacity: list[int], shards: int) -> DataFrame:
    """Rounds of moves. ``blocks`` (grp, block, shard, n): members by the shard they are in. Returns (grp, block, home).

    In each round a group ranks the shards with room by how many of its settled, then of its other members they hold,
    and its blocks ask for the first; those of a group too large for one shard share out as many as it needs. Who isn't
    accepted asks again, until all are or no shard has room for any that is left. Then blocks go on moving to their kin.
    """
    sizes = blocks.groupBy("grp", "block").agg(F.sum("n").alias("size"))
    settled, left, used = None, cut(blocks.join(sizes, ["grp", "block"])), [0] * shards
    turn, ways_out = 0, max(1, shards // 4)
    while not left.isEmpty():
        turn += 1
        room = [c - u for c, u in zip(capacity, used, strict=True)]
        roomy = sorted(range(shards), key=lambda s: -room[s])[:ways_out]
        mean_room = max(1.0, sum(room) / max(1, sum(r > 0 for r in room)))
        groups = left.groupBy("grp").agg(F.sum("n").alias("rows"), F.max("size").alias("need"))
        zero = F.lit(0).cast("long")
        holds = left.groupBy("grp", "shard").agg(F.sum("n").alias("own")).select("grp", "shard", "own", zero.alias("kin"))
        # any of the shards with most room, for a group that finds none where it is
        spare = F.element_at(F.array(*(F.lit(s) for s in roomy)), (F.pmod(F.xxhash64("grp", F.lit(turn)), F.lit(len(roomy))) + 1).cast("int"))
        holds = holds.unionByName(groups.select("grp", spare.alias("shard"), zero.alias("own"), zero.alias("kin")))
        if settled is not None:
            kin = settled.groupBy("grp", F.col("home").alias("shard")).agg(F.sum("size").alias("kin"))
            holds = holds.unionByName(kin.join(groups.select("grp"), "grp", "left_semi").select("grp", "shard", zero.alias("own"), "kin"))
        known = holds.groupBy("grp", "shard").agg(F.sum("own").alias("own"), F.sum("kin").alias("kin")).join(groups, "grp").where(_lookup(room, F.col("shard")) >= F.col("need"))
        best = Window.partitionBy("grp").orderBy(F.desc("kin"), F.desc("own"), F.xxhash64("grp", "shard"), "shard")
        ranked = known.withColumn("rank", F.row_number().over(best)).withColumn("ways", F.least(F.count("*").over(Window.partitionBy("grp")), F.greatest(F.lit(1), F.ceil(F.col("rows") / mean_room))))
        ranked = ranked.where("rank <= ways").select("grp", "ways", (F.col("rank") - 1).alias("pick"), F.col("shard").alias("home"))
        ways = ranked.where("pick = 0").select("grp", "ways")
        asks = left.select("grp", "block", "size").distinct().join(ways, "grp").withColumn("pick", F.pmod("block", "ways")).join(ranked.select("grp", "pick", "home"), ["grp", "pick"])
        accepted = _heard(asks, room)
        gained = _loads(accepted, shards, "home", F.col("size"))
        if not sum(gained):
            if ways_out == 1:  # not even the shard with most room takes one
                break
            ways_out = 1
            continue
        used = [u + g for u, g in zip(used, gained, strict=True)]
        settled = accepted if settled is None else cut(settled.union(accepted))
        left = cut(left.join(accepted.select("grp", "block"), ["grp", "block"], "left_anti"))
    if settled is None:
        return left.sparkSession.createDataFrame([], "grp long, block long, home int")
    room = [c - u for c, u in zip(capacity, used, strict=True)]
    return _propagate(settled, room, shards).select("grp", "block", "home")


def _listed(counted: DataFrame) -> DataFrame:
    """``counted`` with its column ``times`` as that many rows, numbered by ``copy``; large numbers are shared out among tasks first."""
    few, many = counted.where(F.col("times") <= LISTED), counted.where(F.col("times") > LISTED)
    many = many.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / LISTED)))).repartition("grp", "_part")
    start = F.col("_part") * LISTED
    rows = many.withColumn("copy", F.explode(F.sequence(start, F.least(start + LISTED, F.col("times")) - 1))).drop("_part")
    return few.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))).unionByName(rows).drop("times")


def links_cut(sharded: DataFrame, text: str = "text") -> tuple[int, int]:
    """Links between equal texts of ``sharded`` rows (text, shard), and how many of them cross shards."""
    counts = sharded.where(F.col(f"`{text}`").isNotNull()).groupBy(F.xxhash64(F.length(f"`{text}`"), F.col(f"`{text}`")).alias("grp"), "shard").agg(F.count("*").alias("n"))
    pairs = lambda n: F.sum(n * (n - 1) / 2)
    whole = counts.groupBy("grp").agg(F.sum("n").alias("n"), pairs(F.col("n")).alias("within"))
    every, within = whole.agg(pairs(F.col("n")), F.sum("within")).first()
    return int(every or 0), int((every or 0) - (within or 0))


def shard(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, block: int = BLOCK, carry: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of ``docs``; with ``carry`` also its other columns.

    Shards hold numbers of rows at most one apart. ``slot`` counts from 0 within each. Null texts have no bytes, the
    CRC of none, and are linked with nothing; empty texts are equal texts. Repeated rows are rows of their own, as are
    those with null ids. An empty table gives no rows. Other columns may have any names; those named like a new one go.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    grp = F.when(F.col(f"`{text}`").isNotNull(), F.xxhash64(F.length(f"`{text}`"), F.col(f"`{text}`")))
    narrow = docs.select(F.col(f"`{doc_id}`").alias("id"), grp.alias("grp"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    # equal rows are counted, then listed: one that is repeated without end fills no task
    rows = _listed(narrow.groupBy("id", "grp", "size", "text_crc32").agg(F.count("*").alias("times")))
    rows = cut(rows.withColumn("_mix", F.xxhash64(F.lit(24), "id", "copy", "grp")).withColumn("shard", F.pmod("_mix", F.lit(shards)).cast("int")))
    total = rows.count()
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    block = max(1, min(block, total // shards // 4))
    groups = rows.where(F.col("grp").isNotNull()).groupBy("grp").agg(F.count("*").alias("members")).where("members > 1")
    parts = F.ceil(F.col("members") / F.lit(block))
    rows = rows.withColumn("salt", F.pmod(F.shiftright("_mix", 24), F.lit(SALTS)).cast("int"))
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = rows.join(groups, ["grp", "salt"]).withColumn("block", F.pmod(F.shiftright("_mix", 8), parts))
    counts = cut(linked.groupBy("grp", "block", "shard").agg(F.count("*").alias("n")))
    homes = _settle(counts, capacity, shards)
    placed = rows.join(groups, ["grp", "salt"], "left").withColumn("block", F.when(F.col("members").isNotNull(), F.pmod(F.shiftright("_mix", 8), parts)))
    placed = cut(placed.join(homes, ["grp", "block"], "left").withColumn("shard", F.coalesce("home", "shard")).select("id", "copy", "grp", "size", "text_crc32", "_mix", "shard", F.col("home").isNull().alias("free")))
    # free rows make up what is over or missing: those beyond a shard's room fill the others in turn
    firm = _loads(placed.where(~F.col("free")), shards)
    free = _loads(placed.where("free"), shards)
    room = [c - f for c, f in zip(capacity, firm, strict=True)]
    over = [max(0, f - r) for f, r in zip(free, room, strict=True)]
    starts = [sum(over[:s]) for s in range(shards)]
    lacks = [max(0, r - f) for f, r in zip(free, room, strict=True)]
    ends = [sum(lacks[: s + 1]) for s in range(shards)]
    order = [F.col("_mix"), F.col("id"), F.col("copy")]
    binned = placed.withColumn("_bin", F.shiftright("_mix", 52))
    loose = running_total(binned.where("free"), ["shard"], "_bin", order, F.lit(1), "_nth")
    rank = _lookup(starts, F.col("shard")) + F.col("_nth") - _lookup(room, F.col("shard"))
    to = F.lit(shards - 1)
    for s in reversed(range(shards)):
        to = F.when(rank < ends[s], F.lit(s)).otherwise(to)
    moved = loose.withColumn("shard", F.when(F.col("_nth") < _lookup(room, F.col("shard")), F.col("shard")).otherwise(to).cast("int")).drop("_nth")
    final = running_total(moved.unionByName(binned.where(~F.col("free"))), ["shard"], "_bin", order, F.lit(1), "slot")
    out = final.select("id", "grp", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
    if not carry:
        return out.select(F.col("id").alias(doc_id), "size", "text_crc32", "shard", "slot")
    # whole rows and places come together in one shuffle: the n-th row of an id and text takes the n-th place of these
    key, mine = F.xxhash64("id", "grp").alias("_key"), [c for c in docs.columns if c not in NEW]
    row = F.struct(*(F.col(f"`{c}`") for c in mine))
    whole = docs.select(F.col(f"`{doc_id}`").alias("id"), grp.alias("grp"), row.alias("_row")).select("id", "grp", key, "_row")
    found = out.select("id", "grp", key, F.struct(*NEW).alias("_at"))
    both = whole.unionByName(found, allowMissingColumns=True).repartition("_key")
    same = ["_key", "id", "grp"]
    nth = F.row_number().over(Window.partitionBy(*same, F.col("_at").isNull()).orderBy("_at"))
    met = both.withColumn("_nth", nth).groupBy(*same, "_nth").agg(F.first("_row", ignorenulls=True).alias("_row"), F.first("_at", ignorenulls=True).alias("_at"))
    return met.select("_row.*", "_at.*")
