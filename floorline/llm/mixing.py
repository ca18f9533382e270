"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, running_total, unit_interval

#: Weights of sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: Times its size that a source, and so a document, may come at most.
MOST_TIMES = 3
#: Bins of a source's ranks, to a unit of their odds' logarithm, whose sums are added up before documents are ranked within a bin.
BINS = 512
#: Sources up to which their targets are broadcast. With more, documents meet them by source and salt, so that a
#: frequent source fills no task.
BROADCAST_SOURCES = 50_000
SALTS = 32
#: Words of a text that is half as well liked as one without end, where no column says how documents are liked.
HALF_LIKED = 100

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST_TIMES) -> DataFrame:
    """(source, source_size), one row a source, to the same with ``target``.

    Sources in order of code points, null last, take ``weights`` in turn. Targets share all sizes by weight; one that
    would pass ``most`` times its source's size stays there and the rest is shared anew. Sorted by that limit over the
    weight, the capped sources come first: the level is the first one that no later source's limit is below.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    by_limit = everything.orderBy(F.col("source_size") / F.col("_weight"), F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = (
        sizes.withColumn("_weight", pick)
        .withColumn("_at", F.row_number().over(by_limit))
        .withColumn("_capped", F.coalesce(F.sum("source_size").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(most)))
        .withColumn("_rest", F.sum("_weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.sum("source_size").over(everything) - F.col("_capped")) / F.col("_rest"))
    )
    limit = F.col("source_size") * F.lit(float(most))
    fits = F.when(F.col("_level") * F.col("_weight") <= limit, F.struct("_at", "_level"))
    return ranked.withColumn("_first", F.min(fits).over(everything)).select(
        "source", "source_size", F.when(F.col("_first").isNull() | (F.col("_at") < F.col("_first._at")), limit).otherwise(F.col("_first._level") * F.col("_weight")).alias("target")
    )


def _source_key(name: Column) -> Column:
    """Never null, and null apart from every name."""
    return F.concat(F.lit("s"), F.coalesce(F.concat(F.lit("="), name), F.lit("")))


def liking_of(size: Column) -> Column:
    """In thousandths, 0 to 1000: a text of ``HALF_LIKED`` words is half as well liked as one without end. Whole numbers add up alike in any order."""
    return F.floor(F.lit(1000) * size / (size + F.lit(HALF_LIKED))).cast("long")


def _drawn(docs: DataFrame, doc_id: str, text: str, source: str, propensity: str | None, extra: list[Column], weights: tuple, most: float, seed: int, broadcast_sources: int) -> tuple[DataFrame, DataFrame, bool]:
    """Narrow rows with what decides on them, the targets, and whether these are few enough to broadcast."""
    name = F.col(f"`{source}`").cast("string")
    size = word_count(F.col(f"`{text}`"))
    base = docs.select(*extra, F.struct(F.col(f"`{doc_id}`").alias("id")).alias("_id"), name.alias("_name"), _source_key(name).alias("_source"), size.alias("size"), F.lit(None).cast("long").alias("_liking") if propensity is None else F.col(f"`{propensity}`").cast("long").alias("_liking"))
    base = base.withColumn("_liking", F.least(F.lit(1000).cast("long"), F.greatest(F.lit(0).cast("long"), F.coalesce("_liking", liking_of(F.col("size"))))))
    if not extra:
        base = cut(base)  # narrow: words are counted once
    sums = cut(base.groupBy(F.col("_name").alias("source")).agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("_liking")).alias("_liked")))
    targets = source_targets(sums.select("source", "source_size"), weights, most).withColumnRenamed("source", "_n")
    targets = targets.join(sums.select(F.col("source").alias("_m"), "_liked"), F.col("_n").eqNullSafe(F.col("_m"))).select(_source_key(F.col("_n")).alias("_source"), "source_size", "target", "_liked")
    return base, targets, sums.count() <= broadcast_sources


def _meet(rows: DataFrame, targets: DataFrame, few: bool) -> DataFrame:
    """Each row with its source's line of ``targets``; where these are many, by source and salt."""
    if few:
        return rows.join(F.broadcast(targets), "_source")
    salted = targets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(salted, ["_source", "_salt"]).drop("_salt")


def _odds(met: DataFrame, most: float, seed: int) -> DataFrame:
    """Adds expected copies, their whole part, the rest's inclusion odds, and the rank: random odds over inclusion odds, folded into [0, 1].

    Copies expected of a document: its source's ratio, more or less by how it is liked against the mean of its source's words.
    The reach of that is what the ratio leaves to 0 and to ``most``, so none is ever cut off and the words expected are the target.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mean = F.when(F.col("source_size") > 0, F.col("_liked") / F.col("source_size")).otherwise(0.0)
    reach = F.greatest(F.lit(0.0), F.least(ratio, F.lit(float(most)) - ratio))
    rank = F.col("_dice") * (1 - F.col("_part")) / (F.col("_dice") * (1 - F.col("_part")) + (1 - F.col("_dice")) * F.col("_part"))
    return (
        met.withColumn("_expected", F.greatest(F.lit(0.0), F.least(F.lit(float(most)), ratio + reach * (F.col("_liking") - mean) / F.lit(1000.0))))
        .withColumn("_whole", F.floor("_expected"))
        .withColumn("_part", F.col("_expected") - F.col("_whole"))
        .withColumn("_dice", unit_interval(F.lit(seed), F.col("_id.id")))
        .withColumn("_rank", F.when(F.col("_part") > 0, rank).otherwise(F.lit(1.0)))
    )


def _bin(rank: Column) -> Column:
    """By the logarithm of the odds: however small or large the inclusion odds of a source are, its ranks spread over some thousand bins."""
    last = F.lit(64 * BINS)
    odds = F.floor(F.ln(rank / (1 - rank)) * BINS)
    return F.when(rank <= 0, -last).when(rank >= 1, last).otherwise(F.least(F.greatest(odds, -last), last))


def _taken(ranked: DataFrame, few: bool) -> DataFrame:
    """Adds ``_more``: whether a row is among those that its source takes once more, from the lowest rank on."""
    certain = ranked.groupBy("_source").agg(F.sum(F.col("_whole") * F.col("size")).alias("_certain"))
    # only rows that may come once more have a rank: of a capped source there is none
    drawn = running_total(ranked.where("_part > 0").withColumn("_bin", _bin(F.col("_rank"))), ["_source"], "_bin", ["_rank", "_id.id", "size"], F.col("size"), "_before")
    met = _meet(drawn, certain, few).withColumn("_more", F.col("_before") + F.col("size") / 2 <= F.col("target") - F.col("_certain"))
    return met.select(*ranked.columns, "_more").unionByName(ranked.where("_part <= 0").withColumn("_more", F.lit(False)))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", propensity: str | None = None, weights: tuple = WEIGHTS, most: float = MOST_TIMES, seed: int = 17, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row for each row of ``docs``.

    A document's expected copies are its source's target over its size, more for well liked documents and fewer for others:
    by ``propensity``, a column of whole numbers from 0 to 1000, or by length if none is named. The whole part of them is
    certain. For the rest, documents of a source are ranked by random odds over inclusion odds (Pareto order sampling) and
    taken from the top while the words so taken are nearest to what the target still lacks. Random numbers hang on ``seed``
    and the id alone, so reruns agree.

    Null and empty texts have size 0 and null sources are a source of their own. Ties and repeated rows are taken one
    after the other. An empty table gives no rows. Other columns of ``docs`` may have any names.
    """
    base, targets, few = _drawn(docs, doc_id, text, source, propensity, [], weights, most, seed, broadcast_sources)
    copies = (F.col("_whole") + F.col("_more").cast("long")).cast("long")
    out = _taken(_odds(_meet(base, targets, few), most, seed), few).withColumn("copies", copies)
    return out.select(F.col("_id.id").alias(doc_id), F.col("_name").alias(source), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", propensity: str | None = None, weights: tuple = WEIGHTS, most: float = MOST_TIMES, seed: int = 17, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """``docs`` as mixed: each row as often as it is taken, all columns as they are, whatever their names.

    What a source takes once more are its rows up to some rank. So only narrow rows are ranked, and the whole rows meet their
    source's last rank where they are: no text is shuffled. Of rows that tie with the last one some may be taken; these alone,
    equal rows counted first, are numbered.
    """
    base, targets, few = _drawn(docs, doc_id, text, source, propensity, [], weights, most, seed, broadcast_sources)
    place = lambda: F.struct("_rank", "_id.id", "size")
    more = _taken(_odds(_meet(base, targets, few), most, seed), few).where("_more")
    last = more.groupBy("_source").agg(F.max(place()).alias("_last"))
    ties = _meet(more, last, few).where(place().eqNullSafe(F.col("_last"))).groupBy("_source").agg(F.count("*").alias("_ties"))
    ends = cut(targets.join(last, "_source", "left").join(ties, "_source", "left"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(F.col(f"`{c}`").alias(n) for c, n in ((doc_id, "doc_id"), (text, "text"), (source, "source"))), (F.lit(None) if propensity is None else F.col(f"`{propensity}`")).cast("long").alias("liking"))
    size, name = word_count("text"), F.col("source").cast("string")
    liking = F.least(F.lit(1000).cast("long"), F.greatest(F.lit(0).cast("long"), F.coalesce("liking", liking_of(F.col("size")))))
    # what a generator makes is made once: words are counted once a row
    whole = rows.select("_row", F.struct(F.col("doc_id").alias("id")).alias("_id"), _source_key(name).alias("_source"), "liking", F.explode(F.array(size)).alias("size")).withColumn("_liking", liking)
    ranked = _odds(_meet(whole, ends, few), most, seed)
    tie = (F.col("_part") > 0) & F.col("_last").isNotNull() & place().eqNullSafe(F.col("_last"))
    sure = ranked.where(~tie).withColumn("_n", F.col("_whole") + ((F.col("_part") > 0) & F.coalesce(place() < F.col("_last"), F.lit(False))).cast("long"))
    # rows at the last place: equal ones are counted, and the counts taken in turn until the source has its number of them
    at = ranked.where(tie).groupBy("_source", "_row", "_whole", "_ties").agg(F.count("*").alias("_times"))
    before = F.coalesce(F.sum("_times").over(Window.partitionBy("_source").orderBy(F.xxhash64("_row")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = at.withColumn("_n", F.col("_whole") * F.col("_times") + F.greatest(F.lit(0), F.least(F.col("_times"), F.col("_ties") - before)))
    taken = sure.select("_row", F.col("_n").cast("long").alias("_n")).unionByName(at.select("_row", F.col("_n").cast("long").alias("_n"))).where("_n > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).select("_row.*")
