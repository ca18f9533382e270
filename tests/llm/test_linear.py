"""Pages and sources of the kinds that once filled a task: time and bins stay bounded."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from floorline.llm import htmltext, linededup, mixing

OPEN = ["<!--", "<p ", "<script>", "<style>", "<a b='", "<a ", "<a b=\"'", "</p ", "<!", "<?", "<![CDATA[", "<", "&", "</script", "<p title=x'", "<div>", "<script "]
PAGES = "page_id long, url string, html string, lines string"


def test_boilerplate_of_broken_pages_in_linear_time(spark):
    """A megabyte of what isn't closed; the first run compiles."""
    pages = lambda n: spark.createDataFrame([(i, "http://h/", mark * (n // len(mark)), "") for i, mark in enumerate(OPEN)], PAGES).repartition(len(OPEN))
    linededup.drop_boilerplate(pages(1000)).collect()
    start = time.perf_counter()
    assert linededup.drop_boilerplate(pages(1 << 20)).count() == len(OPEN)
    linededup.drop_boilerplate(pages(1 << 20)).agg(F.sum("n_lines")).collect()
    assert time.perf_counter() - start < 5 * len(OPEN)


def test_what_is_not_closed_hides_the_rest(spark):
    rows = [(0, "http://h/", "<p>one<p>two<script>three</p>", ""), (1, "http://h/", "a<br>b<!-- c <br> d", ""), (2, "http://h/", "a<style>x</style>b<p", "")]
    got = {r.page_id: r.text for r in linededup.drop_boilerplate(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {0: "one\ntwo", 1: "a\nb", 2: "ab<p"}


@pytest.mark.parametrize("mark", OPEN)
def test_extraction_of_broken_pages_in_linear_time(mark):
    start = time.perf_counter()
    htmltext.extract_text("<article><p>" + "Some words of an article. " * 20 + "</p>" + mark * ((1 << 20) // len(mark)))
    assert time.perf_counter() - start < 5


def test_a_capped_source_fills_no_bin(spark):
    """Targets of three times a source's size leave nothing to rank; small inclusion odds still spread over bins."""
    rows = [(i, "word " * 10, "a" if i % 4 == 0 else "b") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in ((1000, 1), (1, 1.0005), (1, 2)):
        base, targets, few = mixing._drawn(docs, "doc_id", "text", "source", None, [], weights, 3, 17, 100)
        ranked = mixing._odds(mixing._meet(base, targets, few), 3, 17).where("_part > 0").withColumn("_bin", mixing._bin(F.col("_rank")))
        sizes = [r["count"] for r in ranked.groupBy("_source", "_bin").count().collect()]
        assert max(sizes, default=0) <= 60
    mixed = mixing.mix(docs, weights=(1000, 1)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 10 for r in mixed) and {r.source: r.taken for r in mixed}["a"] == 45_000


def test_a_name_alone_drops_no_part_of_an_article():
    """Names of several words may be what the article is about; comments, share buttons and notices still go, and so do menus outside."""
    prose = "Ten sentences of it, all prose that belongs to the article. " * 10
    parts = ["social-history", "search-for-meaning", "the-long-form", "notice-of-death", "related-work-in-physics", "menuOfTheDay", "forms-of-art share-of-voice"]
    page = "<article><h1>Head</h1>" + "".join(f'<div class="{p}"><p>{prose}</p></div><div id="{p}"><p>{prose}</p></div>' for p in parts)
    gone = ["comments", "comment-list", "commentList", "share-buttons", "search-box", "cookie-notice", "related-posts", "ad", "sidebar-x", "newsletter-today", "comments post-section"]
    page += "".join(f'<div class="{g}"><p>{prose}</p></div>' for g in gone) + "</article>" + f'<div class="social-history"><a href=x>{prose}</a></div>'
    assert htmltext.extract_text(page) == "\n\n".join(["Head", *[prose.strip()] * (2 * len(parts))])
