"""Crawls as a stream over their own log: outcomes are counted in state, and each batch of outcomes releases what is still missing.

The log is a folder of JSON lines (``LOG``). A row "wanted" opens a crawl and says in ord how many entries have to succeed; the
other rows are outcomes of attempts. Each batch of the stream reads new rows, counts them, and appends the outcomes of the
attempts it released, which the next batch reads; the stream falls idle once every crawl has what it wants or has tried all."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.catalog import EVENT, ranked, sample_order
from ..operators.intervals import within
from ..sources.store import drop, kept

LOG = "crawl string, " + EVENT
_COUNTS = "crawl string, wanted long, good long, bad long"
_RELEASE = "crawl string, first long, last long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pool(universe: DataFrame, seed: int = 0) -> DataFrame:
    """crawl, entry_id, rank (from 1 a crawl) of the distinct entries of ``universe`` (crawl, entry_id) in the order of ``seed``,
    kept as a table: the order in which entries are tried."""
    entries = universe.select("crawl", "entry_id").distinct().withColumn("hash", sample_order("entry_id", seed))
    order = ranked(entries, "crawl", "hash", "entry_id").drop("hash")
    first = order.groupBy("crawl").agg(F.min("rank").alias("first"))
    return kept(order.join(first, "crawl").select("crawl", "entry_id", (F.col("rank") - F.col("first") + 1).cast("long").alias("rank")), "pool")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a crawl and Arrow batch, so that no crawl's outcomes pass through one task."""
    for rows in batches:
        each = pd.DataFrame({"crawl": rows["crawl"], "wanted": rows["ord"].where(rows["event"] == "wanted").fillna(0), "good": rows["event"].isin(["download_ok", "download_skip"]), "bad": rows["event"] == "download_error"})
        yield each.groupby("crawl", as_index=False).sum().astype({"wanted": "int64", "good": "int64", "bad": "int64"})


class _Release(StatefulProcessor):
    """State of a crawl: entries wanted, succeeded, failed and released. What is neither wanted any more nor still open is not
    released; after all else the next ranks of the pool are."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counts", "wanted long, good long, bad long, released long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        wanted, good, bad, released = self.state.get() if self.state.exists() else (0, 0, 0, 0)
        for r in rows:
            wanted, good, bad = wanted + int(r["wanted"].sum()), good + int(r["good"].sum()), bad + int(r["bad"].sum())
        missing = wanted - good - (released - good - bad)
        if missing > 0:
            yield pd.DataFrame({"crawl": [key[0]], "first": [released + 1], "last": [released + missing]})
            released += missing
        self.state.update((wanted, good, bad, released))

    def close(self) -> None:
        pass


def want(spark: SparkSession, log: str, targets: dict[str, int]) -> None:
    """Open crawls, each with the number of entries that have to succeed; once a crawl, or its numbers add up."""
    rows = spark.createDataFrame([(c, "wanted", n) for c, n in targets.items()], "crawl string, event string, ord long")
    rows.write.mode("append").json(log)


def _is_whole(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def crawl(spark: SparkSession, log: str, entries: DataFrame, attempt: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Start the stream over ``log``. ``entries`` is a ``pool``; ``attempt`` takes rows of it and gives rows of ``LOG``, one an entry.

    Outcomes of batch n are written to a folder of its own, log/batch-n. A batch that is run again after a failure finds that
    folder whole and leaves it, or writes it anew; a later batch only starts once this one is done, so each outcome is counted
    once and a restart ends with the same entries. State is three counts and a rank a crawl."""
    events = spark.readStream.schema(LOG).option("recursiveFileLookup", True).json(log)

    def run(releases: DataFrame, batch: int) -> None:
        folder = f"{log}/batch-{batch}"
        stored = kept(releases, "releases")  # read whole whatever follows: only so is the state of all crawls stored
        if not _is_whole(stored.sparkSession, folder) and not stored.isEmpty():
            released = within(entries, stored, ["crawl"], "rank", "first", "last").select(*entries.columns)
            attempt(released).write.mode("overwrite").json(folder)
        drop(stored)

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # read when the stream starts
    try:
        releases = events.mapInPandas(_count, _COUNTS).groupBy("crawl").transformWithStateInPandas(_Release(), _RELEASE, "Append", "None")
        return releases.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
