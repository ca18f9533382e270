"""Quarantine and cascading release: turns wait for the turn that they depend on, faulty ones are retried or die.

A turn's delivery hangs on its parent's. As a function of the second at which it may start it is in pieces: before its arrival
it is a constant, later the start plus a delay, or nothing where all attempts fail. Forests of such turns are evaluated by
tree contraction: leaves are raked and chains compressed, functions being composed, until nothing is left; then the nodes are
put back in reverse order, each with its value. All of it are joins by node, however long a chain or large a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

# The rules of arrival, faults and retries.
ARRIVAL_STEP = 7
REACH = 3
FAULT_MODULUS, FAULTY_BELOW, REPAIR_MODULUS, FAIL_MODULUS = 101, 35, 101, 3
#: Seconds from the first attempt to each.
DELAYS = (0, 10, 30, 70, 150)

_NEVER = -(1 << 62)
_FOREVER = 1 << 62
PIECES = "array<struct<lo:bigint,add:bigint,moves:boolean>>"


def piece(lo: Column | int, add: Column | int | None, moves: Column | bool) -> Column:
    """From ``lo`` on: ``add``, plus the start if it ``moves``; null is nothing."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(lo).cast("long").alias("lo"), as_column(add).cast("long").alias("add"), as_column(moves).cast("boolean").alias("moves"))


def simplified(pieces: Column) -> Column:
    """Without pieces that go on like the one before; ``pieces`` are in order."""
    same = lambda a, b: a["add"].eqNullSafe(b["add"]) & ((a["moves"] == b["moves"]) | a["add"].isNull())
    return F.filter(pieces, lambda p, i: (i == 0) | ~same(p, F.get(pieces, i - 1)))


def applied(pieces: Column, start: Column) -> Column:
    """The value at ``start``; null where that is null."""
    before = F.filter(pieces, lambda p: p["lo"] <= start)
    at = F.get(before, F.size(before) - 1)
    return F.when(start.isNotNull(), at["add"] + F.when(at["moves"], start).otherwise(0))


def composed(first: Column, then: Column) -> Column:
    """``then`` after ``first``, piece by piece: within a piece of the first, the pieces of the other that its values meet."""

    def within(p: Column, i: Column) -> Column:
        hi = F.coalesce(F.get(first, i + 1)["lo"], F.lit(_FOREVER))
        # a piece that moves takes [lo, hi) to [low, high); another takes all of it to one value
        low = F.when(p["moves"], F.greatest(p["lo"] + p["add"], F.lit(_NEVER))).otherwise(p["add"])
        high = F.when(p["moves"], hi + p["add"]).otherwise(p["add"] + 1)
        met = F.filter(then, lambda q, j: (q["lo"] < high) & (F.coalesce(F.get(then, j + 1)["lo"], F.lit(_FOREVER)) > low))
        moved = F.transform(met, lambda q: F.when(p["moves"], piece(F.greatest(p["lo"], q["lo"] - p["add"]), q["add"] + F.when(q["moves"], p["add"]).otherwise(0), q["moves"])).otherwise(piece(p["lo"], q["add"] + F.when(q["moves"], p["add"]).otherwise(0), False)))
        return F.when(p["add"].isNull(), F.array(piece(p["lo"], None, False))).otherwise(moved)

    return simplified(F.flatten(F.transform(first, within)))


def evaluate_forest(nodes: DataFrame) -> DataFrame:
    """(conv, p, parent, pieces) to (conv, p, value): each node's function of its parent's value, or of ``_NEVER`` for roots.

    (conv, p) names a node and isn't null; ``parent`` is a p of the same conv, null for roots. Links form a forest. Values are
    whole seconds from 0 on. A node below nothing is nothing (null). Each round rakes all leaves and compresses chain nodes, no
    two in a row, chosen by a coin of their own; so rounds grow with the logarithm of the number of nodes.
    """
    alive = cut(nodes.select("conv", "p", "parent", F.col("pieces").cast(PIECES).alias("pieces")))
    gone: list[DataFrame] = []
    while True:
        step = _round(alive, len(gone))
        gone.append(step.where("out").select("conv", "p", "parent", "pieces"))
        alive = step.where("NOT out").select("conv", "p", "parent", "pieces")
        if alive.isEmpty():
            break
    # expansion: what went last has roots only; what went before hangs on nodes whose values are known by then
    known = None
    for step in reversed(gone):
        root = step.where("parent IS NULL").select("conv", "p", applied(F.col("pieces"), F.lit(_NEVER)).alias("value"))
        if known is None:
            known = cut(root)
            continue
        above = known.select("conv", F.col("p").alias("parent"), F.col("value").alias("start"))
        below = step.where("parent IS NOT NULL").join(above, ["conv", "parent"]).select("conv", "p", applied(F.col("pieces"), F.col("start")).alias("value"))
        known = cut(known.unionByName(root).unionByName(below))
    return known


def _coin(conv: str, p: Column, turn: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(turn), F.col(conv), p), F.lit(2)) == 0


def _round(alive: DataFrame, turn: int) -> DataFrame:
    """``alive`` with ``out``: raked or compressed in this round; the child of a compressed node hangs on that node's parent."""
    children = alive.where("parent IS NOT NULL").groupBy("conv", F.col("parent").alias("p")).agg(F.count("*").alias("children"))
    counted = alive.join(children, ["conv", "p"], "left")
    chain = (F.col("children") == 1) & F.col("parent").isNotNull() & _coin("conv", F.col("p"), turn) & ~_coin("conv", F.col("parent"), turn)
    marked = counted.withColumn("_chain", F.coalesce(chain, F.lit(False)))
    over = marked.where("_chain").select("conv", F.col("p").alias("parent"), F.col("parent").alias("_parent"), F.col("pieces").alias("_pieces"))
    met = marked.join(over, ["conv", "parent"], "left")
    return cut(
        met.select(
            "conv", "p",
            F.when(F.col("_pieces").isNull(), F.col("parent")).otherwise(F.col("_parent")).alias("parent"),
            F.when(F.col("_pieces").isNull(), F.col("pieces")).otherwise(composed(F.col("_pieces"), F.col("pieces"))).alias("pieces"),
            (F.col("_chain") | F.col("children").isNull()).alias("out"),
        )
    )


def _ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` dealt into ranges of ``order``, each row with the number of its range; no key fills a task."""
    return cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def numbered(df: DataFrame, key: str, order: list[Column | str], out: str) -> DataFrame:
    """Adds the number of each row in its ``key``, from 0, by ``order``.

    Rows are dealt into ranges of key and order; of a key only its count in each range meets in one task.
    """
    ranged = _ranged(df, key, *order)
    within = Window.partitionBy(key, "_range").orderBy(*order)
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n")).select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranged.withColumn("_at", F.row_number().over(within)).join(sums, [key, "_range"]).withColumn(out, F.col("_before") + F.col("_at") - 1).drop("_before", "_at", "_range")


def hashed(k: Column | int, conv: Column, turn: Column) -> Column:
    """h(k) of a turn; a null conversation or turn is written ``null``."""
    return F.crc32(F.concat_ws(":", (k if isinstance(k, Column) else F.lit(k)).cast("string"), F.coalesce(conv.cast("string"), F.lit("null")), F.coalesce(turn.cast("string"), F.lit("null"))).cast("binary"))


def with_attempt_pieces(turns: DataFrame) -> DataFrame:
    """Adds ``pieces``, the start-to-delivery function, by (arrival, faulty, repaired, good); ``good`` says for each attempt whether it delivers once repaired.

    Started at s the a-th attempt comes ``DELAYS[a]`` after max(s, arrival); the first good one that isn't before the repair
    delivers. Column after column, as each is used more than once.
    """
    arrival = F.col("arrival")
    # from repaired - DELAYS[a] on attempt a delivers if it is good and no earlier one does; the longest delay comes first
    tries = [F.when(F.get("good", F.lit(a)), piece(F.greatest(F.col("repaired") - d, arrival), d, True)) for a, d in enumerate(DELAYS)]
    late = turns.withColumn("_late", F.filter(F.array(*reversed(tries)), lambda x: x.isNotNull()))
    # of pieces that begin at the arrival only the last, the shortest delay, counts
    late = late.withColumn("_late", F.filter("_late", lambda x, i: F.coalesce(x["lo"] < F.get("_late", i + 1)["lo"], F.lit(True))))
    whole = F.when(~F.col("faulty"), F.array(piece(arrival, 0, True))).when(F.get("_late", F.lit(0))["lo"] == arrival, F.col("_late")).otherwise(F.concat(F.array(piece(arrival, None, False)), "_late"))
    late = late.withColumn("_late", whole)
    first = F.get("_late", F.lit(0))
    return late.withColumn("pieces", F.concat(F.array(piece(_NEVER, F.when(first["moves"], first["add"] + arrival), False)), "_late")).drop("_late")


def plan(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Rows (conv, conv_id, turn, crc, p, parent, arrival, faulty, repaired, good, pieces): when turns arrive and what may happen to them.

    Rows of a conversation are numbered by turn, null first, then by the CRC of their text; equal rows one after the other. Null
    conversations are one conversation.
    """
    body = F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))
    base = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), body.alias("crc"))
    base = base.withColumns({"conv": F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")), "_row": F.monotonically_increasing_id()})
    rows = numbered(base, "conv", [F.col("turn").asc_nulls_first(), F.col("crc"), F.col("_row")], "p").drop("_row")
    h = lambda k: hashed(k, F.col("conv_id"), F.col("turn"))
    back = h(0) % REACH
    arrival = F.col("p") * ARRIVAL_STEP
    faulty = h(1) % FAULT_MODULUS < FAULTY_BELOW
    good = F.array(*(h(a + 2) % FAIL_MODULUS != 0 for a in range(1, len(DELAYS) + 1)))
    rows = rows.withColumns({"parent": F.when((back > 0) & (back <= F.col("p")), F.col("p") - back), "arrival": arrival, "faulty": faulty, "repaired": F.when(faulty, arrival + h(2) % REPAIR_MODULUS), "good": F.when(faulty, good)})
    return cut(with_attempt_pieces(rows))


def released(delivered: DataFrame) -> DataFrame:
    """(conv, p, turn, last_at, crc) to (conv, p, release_no, state): releases of a conversation by (last_at, turn), and the running sum of number times CRC.

    Rows are dealt into ranges of conversation and time; of a conversation only the sums of each range meet in one task. Sums
    are decimals of 38 digits.
    """
    order = [F.col("last_at"), F.col("turn").asc_nulls_first(), F.col("p")]
    ranged = _ranged(delivered, "conv", *order)
    within, before = Window.partitionBy("conv", "_range").orderBy(*order), Window.partitionBy("conv").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    wide = lambda c: c.cast("decimal(38,0)")
    at = ranged.withColumn("_at", F.row_number().over(within).cast("long"))
    at = at.withColumns({"_crcs": F.sum(F.col("crc")).over(within), "_sums": F.sum(wide(F.col("_at") * F.col("crc"))).over(within)})
    sums = at.groupBy("conv", "_range").agg(F.count("*").alias("_n"), F.sum("crc").alias("_c"), F.max("_sums").alias("_s"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")))
    sums = sums.withColumn("_state", F.coalesce(F.sum(wide(F.col("_s")) + wide(F.col("_before") * wide(F.col("_c")))).over(before), wide(F.lit(0)))).select("conv", "_range", "_before", "_state")
    met = at.join(sums, ["conv", "_range"])
    return met.select("conv", "p", (F.col("_before") + F.col("_at")).alias("release_no"), wide(F.col("_state") + F.col("_sums") + wide(F.col("_before") * wide(F.col("_crcs")))).alias("state"))


def replay(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv_id, turn, p, parent, arrival, status, attempts, first_at, last_at, release_no, state), one row for each row of ``turns``.

    Null ids and turns, ties and repeated rows are as :func:`plan` says; a null or empty text has CRC 0. An empty table gives
    no rows. Other columns don't matter, whatever their names. ``state`` is a decimal. What a turn hasn't is null.
    """
    rows = plan(turns, conv_id=conv_id, turn=turn, text=text)
    values = evaluate_forest(rows.select("conv", "p", "parent", "pieces"))
    above = values.select("conv", F.col("p").alias("parent"), F.col("value").alias("_start"), F.lit(True).alias("_above"))
    met = rows.drop("pieces").join(values, ["conv", "p"]).join(above, ["conv", "parent"], "left")
    blocked = F.col("_above").isNotNull() & F.col("_start").isNull()
    first = F.when(~blocked, F.greatest(F.col("arrival"), F.coalesce("_start", "arrival")))
    status = F.when(blocked, "blocked").when(F.col("value").isNull(), "dead").otherwise("delivered")
    delays = F.array(*(F.lit(d).cast("long") for d in DELAYS))
    tried = F.when(blocked, 0).when(F.col("value").isNull(), len(DELAYS)).otherwise(F.array_position(delays, F.col("value") - first)).cast("int")
    done = met.withColumns({"status": status, "attempts": tried, "first_at": first, "last_at": F.when(~blocked, F.coalesce("value", first + DELAYS[-1]))})
    done = cut(done.select("conv", "conv_id", "turn", "p", "parent", "arrival", "status", "attempts", "first_at", "last_at", "crc"))
    order = released(done.where("status = 'delivered'").select("conv", "p", "turn", "last_at", "crc"))
    return done.join(order, ["conv", "p"], "left").select("conv_id", "turn", "p", "parent", "arrival", "status", "attempts", "first_at", "last_at", "release_no", "state")
