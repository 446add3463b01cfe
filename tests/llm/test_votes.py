"""The array of op2 holds every page of every host, also where structure alone would decide."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F
from strandloom.llm import pagetext
from strandloom.llm.queries import QUERIES


def plain_repeats(pages, min_run=8):
    """page_id and tokens in windows that another text of the host holds, every window compared with all others."""
    streams = [(i, url.split("://")[1].split("/")[0].lower(), tuple(w for _, t in pagetext.page_blocks(html) for w in t.split())) for i, url, html in pages]
    holders = defaultdict(set)
    for _, host, tokens in streams:
        for k in range(len(tokens) - min_run + 1):
            holders[host, tokens[k : k + min_run]].add(tokens)
    starts = lambda host, t: [k for k in range(len(t) - min_run + 1) if len(holders[host, t[k : k + min_run]]) > 1]
    return {i: len({p for k in starts(host, t) for p in range(k, k + min_run)}) for i, host, t in streams}


def test_every_marked_page_is_in_the_array(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert all(pagetext.marked_text(pagetext.page_blocks(html)) is not None for _, _, html in rows)  # structure decides all
    got = {r.page_id: r for r in QUERIES["op2_main_text"](spark, sf_dir).collect()}
    want = plain_repeats(rows)
    assert {i: r.n_repeated for i, r in got.items()} == want and sum(n > 0 for n in want.values()) > 5
    assert {i: r.text for i, r in got.items()} == {i: pagetext.marked_text(pagetext.page_blocks(html)) for i, _, html in rows}


def test_votes_of_marked_and_open_pages(spark):
    menu = "home news sport weather travel culture money contact us"
    rows = [(k, f"http://h{k % 2}.org/{k}", f"<nav>{menu}</nav><article><p>unique text of page number {k} stands right here</p></article>") for k in range(4)]
    rows += [(9, "http://other.org/", f"<nav>{menu}</nav><article>alone</article>"), (7, "http://h0.org/", f"<p>{menu}</p><p>open page</p>"), (7, "http://h0.org/", f"<p>{menu}</p><p>open page</p>")]
    out = pagetext.voted_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    # menu and the five words after it are common to the marked pages of a host
    got = sorted(map(tuple, out.select("page_id", "text", F.col("n_repeated")).collect()))
    assert got == sorted([(k, f"unique text of page number {k} stands right here", 14) for k in range(4)] + [(9, "alone", 0), (7, "open page", 9), (7, "open page", 9)])
