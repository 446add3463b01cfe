"""Archive entries: id files, pages, samples, top-up, downloads and their events."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import kept

#: Hexadecimal digits that a round of selection looks at, and rows that its last bin may hold.
DIGITS, EDGE_ROWS = 3, 4096
#: Ids on one line of an id file.
IDS_A_LINE = 10_000
EVENT = "event string, id string, path string, size_bytes long, status int, reason string, attempts int, elapsed_ms long, ord long"


def split_ids(texts: DataFrame) -> DataFrame:
    """source, ord, entry_id of texts (source, text): tokens between commas and line ends, trimmed, empty ones dropped, repeats kept."""
    rows = texts.select("source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "[,\n]")).alias("ord", "entry_id"))
    return rows.withColumn("entry_id", F.trim(F.regexp_replace("entry_id", r"^\s+|\s+$", ""))).filter("entry_id <> ''")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return split_ids(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text")))


def join_ids(ids: DataFrame) -> DataFrame:
    """source, text: the ids (source, ord, entry_id) of each source joined by commas in their order."""
    return ids.groupBy("source").agg(F.expr("listagg(entry_id, ',') within group (order by ord)").alias("text"))


def write_ids(ids: DataFrame, path: str, append: bool = False) -> None:
    """Id files below ``path`` of comma-joined ids, valid for ``read_ids``; ``append`` adds files. A line holds at most
    ``IDS_A_LINE`` ids of one source, so a source of any size is written by many tasks."""
    parts = ids.withColumn("source", F.struct("source", F.floor(F.col("ord") / IDS_A_LINE).alias("part")))
    join_ids(parts).select("text").write.mode("append" if append else "errorifexists").text(path)


def with_totals(answers: DataFrame) -> DataFrame:
    """``answers`` (JSON body) with total: total_count, total or response.numFound, whichever comes first."""
    parsed = F.from_json("body", "total_count long, total long, response struct<numFound:long>")
    return answers.withColumn("total", F.coalesce(parsed["total_count"], parsed["total"], parsed["response"]["numFound"]))


def count_entries(answers: DataFrame) -> DataFrame:
    return with_totals(answers).select("total")


def page_ids(pages: DataFrame) -> DataFrame:
    """page, ord, entry_id from JSON pages (page, body): identifier, entry_id or id of the results, strings only."""
    item = "array<struct<identifier:string,entry_id:string,id:string>>"
    parsed = F.from_json("body", f"result_set {item}, resultSet {item}")
    rows = pages.select("page", F.posexplode(F.coalesce(parsed["result_set"], parsed["resultSet"])).alias("ord", "r"))
    return rows.select("page", "ord", F.coalesce("r.identifier", "r.entry_id", "r.id").alias("entry_id")).filter("entry_id is not null")


def page_request(template: dict, start: int, rows: int) -> str:
    """The search template with its page set."""
    options = template.get("request_options", {}) | {"paginate": {"start": start, "rows": rows}}
    return json.dumps(template | {"request_options": options})


def page_plan(totals: DataFrame, page_size: int = 1000) -> DataFrame:
    """start, rows of the requests that enumerate ``totals`` (total): pages up to the total, the last one truncated."""
    pages = totals.filter("total > 0").select("total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / page_size))).alias("page"))
    start = F.col("page") * page_size
    return pages.select(start.alias("start"), F.least(F.lit(page_size), F.col("total") - start).alias("rows"))


def up_to_empty(pages: DataFrame) -> DataFrame:
    """Ids (page, ord, entry_id) of the pages before the first empty one; ``pages`` (page, body) as for ``page_ids``."""
    found = page_ids(pages)
    filled = pages.select("page").join(found.select("page").distinct().withColumn("filled", F.lit(True)), "page", "left")
    first = filled.agg(F.min(F.when(F.col("filled").isNull(), F.col("page"))).alias("first_empty"))  # one row
    return found.join(F.broadcast(first), F.col("first_empty").isNull() | (F.col("page") < F.col("first_empty"))).drop("first_empty")


def enumerate_entries(spark: SparkSession, total: int, request: Callable[[int, int], str], page_size: int = 1000, parallel: int = 8) -> DataFrame:
    """page, ord, entry_id of all pages up to ``total``; ``request`` (start, rows) gives the body of one page and runs in
    ``parallel`` tasks. Pages after an empty one do not count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page": batch["start"] // page_size, "body": [request(int(a), int(n)) for a, n in zip(batch["start"], batch["rows"], strict=True)]})

    plan = page_plan(spark.createDataFrame([(total,)], "total long"), page_size).repartition(parallel, "start")
    return up_to_empty(plan.mapInPandas(run, "page long, body string"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with rank (from 0) in the total order of the columns ``order``. Ranges of the order are numbered in
    parallel: a row's rank is its rank inside its range plus the rows of the ranges before. The ranges are kept as a
    table, so that counting and numbering see the same ones."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row a range
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("inside") - 1).drop("part", "before", "inside")


def number_pages(ids: DataFrame, order: str, page_size: int = 1000) -> DataFrame:
    """page and place of each row in the total order of ``order``."""
    rank = F.col("rank")
    return ranked(ids, order).withColumn("page", F.floor(rank / page_size)).withColumn("place", rank % page_size).drop("rank")


def by_score(results: DataFrame) -> DataFrame:
    """Search results (entry_id, score) with their rank by falling score; equal scores by id, null scores last."""
    return ranked(results.withColumn("down", F.coalesce(-F.col("score"), F.lit(float("inf")))), "down", "entry_id").drop("down")


def sample_size(n: int, percent: float) -> int:
    p = max(0.0, min(100.0, percent))
    return 0 if not n or not p else max(1, int(n * p // 100))


def sample_order(column: str, seed: int) -> Column:
    """Arithmetic order of a sample: the MD5 of seed and id; no id counts as an empty one."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit(""))).cast("binary"))


def first_in_order(rows: DataFrame, k: int, seed: int = 0, column: str = "entry_id") -> DataFrame:
    """The first ``k`` of ``rows`` in ``sample_order`` (then by id), found without sorting them.

    A histogram over the leading digits of the hash tells in which bin the k-th row lies; that bin is cut by the next digits,
    until it holds at most ``EDGE_ROWS`` rows, which alone are put in order. What lies below the bin is taken by a filter. A
    histogram has at most 16 ^ ``DIGITS`` rows, so each round is one aggregation of counts."""
    if k <= 0:
        return rows.limit(0)
    own = F.struct("*").alias("row")  # columns of any name stay as they are
    hashed, prefix, need, n = rows.select(own, F.col(column).alias("entry"), sample_order(column, seed).alias("hash")), "", k, 0
    while not prefix or n > EDGE_ROWS and len(prefix) < 32:
        inside = hashed.filter(F.col("hash").startswith(prefix))
        bins = inside.groupBy(F.substring("hash", len(prefix) + 1, DIGITS).alias("digits")).count().collect()
        if sum(r["count"] for r in bins) <= need:
            return rows  # there are no more than k
        for digits, n in sorted(map(tuple, bins)):
            if n > need:
                prefix += digits
                break
            need -= n
    below = hashed.filter(F.substring("hash", 1, len(prefix)) < prefix)
    edge = hashed.filter(F.col("hash").startswith(prefix))
    if n <= EDGE_ROWS:
        edge = edge.withColumn("rank", F.row_number().over(Window.orderBy("hash", "entry")) - 1)
    else:  # one hash: rows that repeat an id
        edge = ranked(edge, "entry")
    return below.unionByName(edge.filter(F.col("rank") < need).drop("rank")).select("row.*")


def sample(ids: DataFrame, percent: float, seed: int = 0, column: str = "entry_id") -> DataFrame:
    """A sample without replacement of the size that ``sample_size`` gives, the same for the same seed: the first rows in
    ``sample_order``."""
    return first_in_order(ids, sample_size(ids.count(), percent), seed, column)


def top_up(universe: DataFrame, attempted: DataFrame, column: str = "entry_id") -> DataFrame:
    """Entries not attempted yet, repeats kept."""
    return universe.join(attempted.select(column).distinct(), column, "left_anti")


def success_counts(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if(F.col("event").isin("download_ok", "download_skip")).alias("ok"), F.count_if(F.col("event") == "download_error").alias("failed"))


def warning_categories(warnings: DataFrame) -> DataFrame:
    """Structures that have warnings of each category, and structures with any: one row."""
    kinds = {"altloc": "AltLoc", "heuristic": "Heuristic", "coordinates": "missing coordinates"}
    flags = [F.bool_or(F.contains("warning", F.lit(text))).cast("int").alias(k) for k, text in kinds.items()]
    other = F.bool_or(~sum((F.contains("warning", F.lit(t)).cast("int") for t in kinds.values()), F.lit(0)).cast("boolean")).cast("int").alias("other")
    each = warnings.groupBy("structure_id").agg(*flags, other)
    return each.agg(F.count("*").alias("n_structures"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in (*kinds, "other")])


def warning_lists(warnings: DataFrame, cap: int = 5000) -> DataFrame:
    """At most ``cap`` warnings a structure, a fixed bound of the metadata record."""
    w = Window.partitionBy("structure_id").orderBy("warning")
    return warnings.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap).groupBy("structure_id").agg(F.array_sort(F.collect_list("warning")).alias("warnings"))


def retry_delay(attempt: int, status: int | None, retry_after: str | float | None, base: float = 0.5, most: float = 15.0) -> float | None:
    """Seconds to wait before the next try, without jitter; None if the failure is final. 429 honours Retry-After up to the
    cap, where it is a number; else waits double up to the cap."""
    if status is not None and status != 429 and not 500 <= status < 600:
        return None
    if status == 429 and retry_after is not None:
        try:
            return min(most, float(retry_after))
        except ValueError:
            pass
    return min(most, base * 2**attempt)


def retry_delays(attempts: DataFrame, base: float = 0.5, most: float = 15.0) -> DataFrame:
    """``attempts`` (attempt, status, retry_after as text) with delay, as ``retry_delay`` has it: null if final."""
    asked = F.when(F.col("status") == 429, F.col("retry_after").try_cast("double"))
    again = F.col("status").isNull() | (F.col("status") == 429) | F.col("status").between(500, 599)
    return attempts.withColumn("delay", F.when(again, F.least(F.lit(most), F.coalesce(asked, base * F.pow(F.lit(2.0), F.col("attempt"))))))


FORMATS = ("cif", "pdb")


def download_plan(ids: DataFrame, base_url: str, folder: str, file_format: str = "pdb") -> DataFrame:
    """ord, entry_id, url, target of the ids (ord, entry_id) to fetch; trimmed, blank ones left out."""
    if file_format.lower() not in FORMATS:
        raise ValueError(f"unknown format: {file_format}")
    name = F.concat(F.col("entry_id"), F.lit(f".{file_format.lower()}"))
    named = ids.withColumn("entry_id", F.trim("entry_id")).filter("entry_id <> ''")
    return named.select("ord", "entry_id", F.concat(F.lit(base_url.rstrip("/") + "/"), name).alias("url"), F.concat(F.lit(folder.rstrip("/") + "/"), name).alias("target"))


def parallel_tasks(asked: str | int | None, cores: int) -> int:
    """Tasks that download at once: the positive number asked for, else ("auto" or anything else) half the cores."""
    text = str(asked)
    return int(text) if text.isdigit() and int(text) > 0 else max(1, cores // 2)


Fetch = Callable[[str], tuple[int, bytes, str | None]]


def download(plan: DataFrame, fetch: Fetch, sink: Callable[[str, bytes], None], done: DataFrame | None = None, parallel: int = 8, retries: int = 5, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Events of the downloads of ``plan`` (see ``download_plan``), with the ord of their ids; entries whose target is in
    ``done`` (target, size_bytes) with a positive size are skipped and count as fetched.

    ``fetch`` (url) gives status, body and the Retry-After header; ``sink`` (target, body) stores a file. A failed try is
    repeated ``retries`` times after ``retry_delay`` and up to a tenth more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for place, entry, url, target in zip(batch["ord"], batch["entry_id"], batch["url"], batch["target"], strict=True):
                began, attempt = time.monotonic(), 0
                while True:
                    try:
                        status, body, later = fetch(url)
                        reason = {429: "rate_limited"}.get(status, "server_error" if status >= 500 else "client_error")
                    except OSError as e:
                        status, body, later, reason = None, b"", None, type(e).__name__
                    attempt += 1
                    if status == 200:
                        sink(target, body)
                        break
                    delay = retry_delay(attempt - 1, status, later)
                    if delay is None or attempt > retries:
                        break
                    wait(delay * (1 + random.random() / 10))
                good = status == 200
                out.append(("download_ok" if good else "download_error", entry, target, len(body) if good else None, status, None if good else reason, attempt, int((time.monotonic() - began) * 1000), place))
            columns = ["event", "id", "path", "size_bytes", "status", "reason", "attempts", "elapsed_ms", "ord"]
            yield pd.DataFrame(out, columns=columns).astype({"size_bytes": "Int64", "status": "Int32"})

    if done is None:
        return plan.repartition(parallel).mapInPandas(run, EVENT)
    have = done.filter("size_bytes > 0").select("target").distinct()
    none = F.lit(None)
    skipped = plan.join(have, "target", "left_semi").select(F.lit("download_skip").alias("event"), F.col("entry_id").alias("id"), F.col("target").alias("path"), none.cast("long").alias("size_bytes"), none.cast("int").alias("status"), F.lit("exists").alias("reason"), none.cast("int").alias("attempts"), none.cast("long").alias("elapsed_ms"), F.col("ord").cast("long"))
    return plan.join(have, "target", "left_anti").repartition(parallel).mapInPandas(run, EVENT).unionByName(skipped)


def fetched_paths(events: DataFrame) -> DataFrame:
    """ord, path of the downloads that hold a file, fetched now or before, numbered as their ids were."""
    return events.filter(F.col("event").isin("download_ok", "download_skip")).select("ord", "path")


def write_events(events: DataFrame, path: str) -> None:
    """Append events to a log of JSON lines; null fields are left out of a line."""
    events.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)


def fetch_exactly(universe: DataFrame, target: int, attempt: Callable[[DataFrame], DataFrame], column: str = "entry_id", seed: int = 0) -> DataFrame:
    """Attempts until ``target`` entries succeed or none are left; only counts reach the driver. ``attempt`` takes ids and
    returns stored events."""
    pool = kept(universe.select(column).distinct(), "pool")
    events = None
    have = 0
    while have < target:
        left = pool if events is None else kept(top_up(pool, events.select(F.col("id").alias(column)), column), "pool")
        got = attempt(first_in_order(left, target - have, seed, column))
        n = got.count()
        if not n:
            break
        events = got if events is None else events.unionByName(got)
        have += success_counts(got).first()["ok"]
    return events if events is not None else attempt(universe.limit(0).select(column))
