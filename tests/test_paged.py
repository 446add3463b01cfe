"""The paged data source: batches of known pages, and a stream that goes on where it stopped."""

from __future__ import annotations

import json

import pytest
from strandloom.operators import catalog
from strandloom.sources.paged import PagedAnswers, _Reader, fetch_page


def _page(first, n):
    return json.dumps({"result_set": [{"identifier": f"e{k}"} for k in range(first, first + n)]})


def test_batches_of_pages(spark, tmp_path):
    spark.dataSource.register(PagedAnswers)
    for p in range(3):
        (tmp_path / f"{p * 10}-{min(10, 25 - p * 10)}").write_text(_page(p * 10, min(10, 25 - p * 10)))
    pages = spark.read.format("paged").option("url", f"file://{tmp_path}/{{start}}-{{rows}}").option("total", 25).option("pageSize", 10).option("pagesATask", 2).load()
    assert pages.rdd.getNumPartitions() == 2
    assert sorted(r["entry_id"] for r in catalog.page_ids(pages).collect()) == sorted(f"e{k}" for k in range(25))
    assert [(p.first, p.end) for p in _Reader({"url": "u", "total": "0"}).partitions()] == []
    none = spark.read.format("paged").option("url", f"file://{tmp_path}/none-{{page}}").option("total", 25).option("pageSize", 10).load()
    assert none.count() == 0


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(PagedAnswers)
    (tmp_path / "in").mkdir()
    seen = []

    def run():
        stream = spark.readStream.format("paged").option("url", f"file://{tmp_path}/in/{{page}}").option("pagesATask", 2).load()
        query = stream.writeStream.foreachBatch(lambda df, _: seen.append(sorted(r["entry_id"] for r in catalog.page_ids(df).collect()))).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        query.processAllAvailable()
        query.stop()

    for p in range(3):
        (tmp_path / "in" / str(p)).write_text(_page(p, 1))
    run()
    assert sorted(sum(seen, [])) == ["e0", "e1", "e2"]
    (tmp_path / "in/3").write_text(_page(3, 1))
    run()
    assert sorted(sum(seen, [])) == ["e0", "e1", "e2", "e3"]


def test_failures_are_raised():
    with pytest.raises((OSError, ValueError)):
        fetch_page("nowhere:{page}", 0, 10, 10, retries=0)
