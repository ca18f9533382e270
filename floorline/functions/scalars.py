"""Small rules of the engine as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as C


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def ms_to_sample(ms: Column) -> Column:
    return half_up(ms / 1000 * C.SAMPLE_RATE)


def rounded4(x: Column) -> Column:
    return half_up(x * 1e4) / 1e4


def percent(share: Column) -> Column:
    return half_up(share * 100)


def clock(ms: Column) -> Column:
    """m:ss, never below 0:00."""
    seconds = F.greatest(half_up(ms / 1000), F.lit(0)).cast("long")
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("long"), F.pmod(seconds, F.lit(60)))


def palette(identity: Column) -> Column:
    return F.pmod(identity, F.lit(8))


def mel(hz: Column) -> Column:
    return F.lit(1127.0) * F.log1p(hz / 700)


def splinter_headroom(n: Column) -> Column:
    """Groups beyond the head count that clustering may form, one for every 25 samples, eight at most."""
    return F.least(F.lit(C.SPLINTER_MOST), F.floor(n / C.SPLINTER_EVERY)).cast("int")


def parse_names(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def next_count(edited: Column, current: Column, names: Column) -> Column:
    """What the head-count field shows next: as edited, or the number of names if there are two or more."""
    return F.when(edited, current).when(F.size(names) >= 2, F.size(names).cast("string")).otherwise("")


def valid_count(n: Column) -> Column:
    """A head count: a whole number from 2 up, or null."""
    return F.when((n >= 2) & (n == F.floor(n)) & ~F.isnan(n.cast("double")), n.cast("int"))


def resolve_count(calibrated: Column, count: Column, names: Column) -> Column:
    """(k, source, confident): calibrated profiles come first, then a stated count, then names; else automatic."""
    named = F.size(F.filter(names, lambda x: F.trim(x) != ""))

    def hint(k: Column, source: str) -> Column:
        return F.struct(k.cast("int").alias("k"), F.lit(source).alias("source"), F.lit(source != "automatic").alias("confident"))

    return F.when(calibrated >= 2, hint(calibrated, "calibrated")).when(valid_count(count).isNotNull(), hint(count, "count")).when(named >= 2, hint(named, "names")).otherwise(hint(F.lit(None), "automatic"))


def reliability(samples: Column, speakers: Column) -> Column:
    return F.when((samples < 2) | (speakers == 0), "insufficient").when(samples / speakers < C.SAMPLES_PER_SPEAKER, "low").otherwise("good")


def stalled(running: Column, elapsed_ms: Column, covered_ms: Column) -> Column:
    return running & (elapsed_ms - covered_ms > C.STALL_MS)


def live_warning(samples: Column, is_stalled: Column, reliable: Column, clear: Column, heavy: Column) -> Column:
    """The one warning of the live page: a stall, then too few samples, then muddled voices and overlap together."""
    both = F.concat_ws(" ", F.when(~clear, F.lit("unclear")), F.when(heavy, F.lit("overlap")))
    return F.when(is_stalled, "stalled").when(samples == 0, "").when(reliable != "good", F.concat(F.lit("reliability-"), reliable)).otherwise(both)


def file_warning(reliable: Column, heavy: Column) -> Column:
    return F.when(reliable != "good", F.concat(F.lit("reliability-"), reliable)).when(heavy, "overlap").otherwise("")


def large_table_hint(people: Column, introduced: Column) -> Column:
    return (people >= 4) & ~introduced


def input_level(rms: Column) -> Column:
    return F.least(F.lit(1.0), rms * 4)


def on_boundary(edge_ms: Column, within: float = 60.0) -> Column:
    """Whether an edge lies within ``within`` ms of a trust boundary: 2.5 s and every 5 s from there."""
    off = F.pmod(edge_ms - 2_500, F.lit(C.HOP_MS))
    return (off < within) | (off > C.HOP_MS - within)


def window_number(end_ms: Column) -> Column:
    """Number of the live window that first trusts a sample ending at ``end_ms``."""
    return F.greatest(F.lit(0), F.ceil((end_ms - 7_500) / C.HOP_MS)).cast("int")


def choose_locale(stored: Column, preferred: Column, known: tuple[str, ...] = ("en", "es")) -> Column:
    """The stored language if it is known, else the first preferred one whose base is, else the first known."""
    bases = F.transform(preferred, lambda t: F.split(F.lower(t), "-")[0])
    fits = F.filter(bases, lambda b: b.isin(*known))
    return F.when(stored.isin(*known), stored).when(F.size(fits) > 0, F.get(fits, F.lit(0))).otherwise(F.lit(known[0]))


def translated(key: Column, language: Column, messages: dict[str, dict[str, str]], default: str = "en") -> Column:
    """``messages`` by language and key: the text in ``language``, else in ``default``, else the key itself."""
    def lookup(texts: dict[str, str]) -> Column:
        pairs = [F.lit(x) for pair in texts.items() for x in pair]
        return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")

    found = F.lit(None).cast("string")
    for name, texts in messages.items():
        found = F.when(language == name, lookup(texts)).otherwise(found)
    return F.coalesce(found, lookup(messages.get(default, {})), key)
