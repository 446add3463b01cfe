"""Crawls as streams: they end with what is wanted, also when stopped in the middle."""

from __future__ import annotations

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from strandloom.operators.catalog import first_in_order
from strandloom.streaming.crawl import LOG, crawl, pool, want


def _good(entry):
    return entry % 3 != 0


def _attempt(rows):
    n = F.substring("entry_id", 2, 9).cast("int")
    out = rows.select("crawl", F.when(n % 3 != 0, "download_ok").otherwise("download_error").alias("event"), F.col("entry_id").alias("id"), F.col("rank").alias("ord"))
    return out.select("crawl", "event", "id", "ord")


def _outcomes(spark, log):
    return spark.read.schema(LOG).option("recursiveFileLookup", True).json(str(log)).filter("event <> 'wanted'").select("crawl", "event", "id", "ord").collect()


def _expected(order, wanted):
    """The entries tried one after another until enough succeed."""
    tried = []
    for entry in order:
        if sum(_good(int(e[1:])) for e in tried) == wanted:
            break
        tried.append(entry)
    return tried


@pytest.fixture(scope="module")
def entries(spark):
    sizes = {"a": 60, "b": 5, "c": 20}
    rows = spark.createDataFrame([(c, f"e{n}") for c, m in sizes.items() for n in range(m)] + [("a", "e1")], "crawl string, entry_id string")
    return pool(rows, seed=4)


def _order(entries, c):
    return [r.entry_id for r in entries.filter(F.col("crawl") == c).orderBy("rank").collect()]


@pytest.mark.parametrize("broken", [None, "before", "after"])
def test_crawls_end_with_what_is_wanted(spark, tmp_path, entries, broken):
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    want(spark, log, {"a": 25, "b": 9, "c": 0})
    left = [2] if broken else []

    def attempt(rows):
        if left:
            left[0] -= 1
            if not left[0]:
                left.clear()
                if broken == "after":  # the outcomes are in the log, but the batch is not done
                    _attempt(rows).write.mode("overwrite").json(f"{log}/batch-1")
                raise RuntimeError("stopped in the middle")
        return _attempt(rows)

    for _ in range(2):
        query = crawl(spark, log, entries, attempt, checkpoint)
        try:
            query.processAllAvailable()
            break
        except StreamingQueryException:
            assert broken and not left
        finally:
            query.stop()
    got = _outcomes(spark, log)
    tried = {c: [r.id for r in sorted(got, key=lambda r: r.ord) if r.crawl == c] for c in "abc"}
    assert tried["a"] == _expected(_order(entries, "a"), 25)
    assert tried["b"] == _order(entries, "b")  # all of them, fewer than wanted succeed
    assert tried["c"] == []
    assert not left


def test_a_pool_is_in_the_order_of_its_seed(spark, entries):
    order = _order(entries, "a")
    assert len(order) == 60
    rows = entries.filter("crawl = 'a'")
    assert sorted(order[:7]) == sorted(r.entry_id for r in first_in_order(rows, 7, seed=4).collect())
