"""Line dedup by site: lines on too large a share of a host's pages are boilerplate and go; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

#: Lines on more than this share of a host's pages are dropped.
RATIO = 0.2
#: And on this many pages at least: on a host of few pages a share says nothing.
LEAST_PAGES = 3
#: Common lines, by host and hash, up to which they are broadcast; beyond, pages and lines meet by host and salt.
BROADCAST_LINES = 200_000
SALTS = 64

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)"
#: Markup whose content is no text, elements that end a line, tags as HTML has them, and the commonest references.
#: What isn't closed goes on to the page's end, and a tag ends before the next one begins: so each pattern reads a page once.
SILENT = r"(?is)<script\b[^<>]*>.*?(?:</script\s*>|\z)|<style\b[^<>]*>.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?:[\s/][^<>]*)?>"
TAGS = r"</?[a-zA-Z][^<>]*>|<[!?][^<>]*>"
#: The first of them once more, as Java's patterns have it without a step back: runs of other characters are taken whole.
SILENT_WHOLE = r"(?i)<(?:script\b[^<>]*+>[^<]*+(?:<(?!/script\s*+>)[^<]*+)*+(?:</script\s*+>)?|style\b[^<>]*+>[^<]*+(?:<(?!/style\s*+>)[^<]*+)*+(?:</style\s*+>)?|!--[^-]*+(?:-(?!->)[^-]*+)*+(?:-->)?)"
#: White space that isn't one space already: most is, and each match costs.
SPACES = r"[ \t\r\f]{2,}|[\t\r\f]"
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    """In lower case, without user names and port."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def lines_of(html: Column) -> Column:
    """Lines of a page, in order: markup gone, the commonest references decoded, runs of white space as one space, without empty ones."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), SILENT_WHOLE, ""), BREAKS.replace("[^<>]*", "[^<>]*+"), "\n"), TAGS.replace("[^<>]*", "[^<>]*+"), "")
    for name, sign in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.filter(F.transform(F.split(F.regexp_replace(text, SPACES, " "), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", ratio: float = RATIO, least_pages: int = LEAST_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """(page_id, url, host, n_lines, n_dropped, text): each row of ``pages`` without its site's boilerplate.

    A line counts once a page. Null and empty pages have no lines and an empty text, but count as pages. URLs that are
    null or have no host are one site, named by the empty string. Repeated rows are pages of their own; an empty table gives
    no rows. Other columns may have any names. A script, style or comment that isn't closed hides the rest of its page. Hot hosts and
    lines are counted before they are shuffled, and only hashes of lines travel. Pages stay where they are read while the
    common lines are few enough to broadcast; else a host's pages are dealt out by salt.
    """
    base = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), host_of(F.col(f"`{url}`")).alias("host"), lines_of(F.col(f"`{html}`")).alias("lines"))
    hashed = base.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
    totals = base.groupBy("host").agg(F.count("*").alias("pages"))
    counts = hashed.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    # a large host's lines would fill a task where they meet its one total, so they meet it by salt
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    totals = totals.withColumn("salt", F.explode(salts))
    counts = counts.withColumn("salt", F.pmod("line", F.lit(SALTS)).cast("int"))
    common = cut(counts.join(totals, ["host", "salt"]).where(F.col("n") > F.lit(ratio) * F.col("pages")).select("host", "line"))
    # of a page's lines not more than 1/ratio can be common on average, so a host's list is as short as a few pages
    lists = common.groupBy("host").agg(F.collect_set("line").alias("common"))
    if common.count() <= broadcast_lines:
        marked = base.join(F.broadcast(lists), "host", "left")
    else:
        salted = lists.withColumn("salt", F.explode(salts))
        marked = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    marked = marked.withColumn("common", F.coalesce("common", F.array().cast("array<bigint>")))
    kept = F.filter("lines", lambda x: ~F.array_contains("common", F.xxhash64(x)))
    return marked.withColumn("kept", kept).select(
        F.col("page_id").alias(page_id), F.col("url").alias(url), "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text")
    )
