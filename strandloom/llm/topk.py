"""Exact top-k search by inner product, with vectors grouped in buckets of like length.

Vectors are cut by falling length into buckets (at most ``BUCKETS``), and each bucket by hash into blocks of bounded size.
Queries meet the blocks in two waves: first those of the longest vectors, then the rest with what the first wave found as a
threshold. A query needs a bucket only if its length times the longest one there reaches its threshold. Inside a bucket the
threshold becomes a local one on the cosine, threshold / (query length * bucket length), and decides how candidates are
pruned: below the bucket's cut by length (only vectors long enough can reach the threshold), above it by coordinates (a
candidate's coordinate must lie near the query's, the nearer the higher the cosine). The cut is chosen for each block of
queries from what its sorted coordinate lists would leave. Every candidate that is left has its product computed.

No pair that could enter a result is left out: pruning uses bounds on the product with a margin for rounding, and keeps
ties. A task holds one block of vectors and one of queries, whatever the input; equal vectors, however many, are dealt by hash
like others. What a block sends on are products of at least the query's threshold, at most k a query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K = 20
SCALE = 64
BUCKETS = 64
#: Rows of a block at most (hashing makes some a little larger), and of a bucket at least.
BLOCK, LEAST = 4096, 512
#: The first wave takes the buckets that hold this share of all vectors.
FIRST = 1 / 32
#: Coordinates looked at for a query, queries multiplied at once.
FOCUS, AT_ONCE = 4, 256
#: Margin on lengths and cosines for rounding; products beyond the range of longs saturate.
MARGIN = 1e-9
LIMIT = (1 << 63) - 1
FOUND = "query long, vec_id long, row long, score long"


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, v (array of floor(scale * x), as longs), length for each usable vector of ``embedding``."""
    x = F.col("embedding").cast("array<double>")
    usable = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c).cast("long"))
    rows = vectors.filter(F.col("embedding").isNotNull() & usable).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of longs; missing components are 0."""
    column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out, flat = np.zeros((len(sizes), width), np.int64), column.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(queries: np.ndarray, vectors: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of whole vectors; ``bound`` is over the size of any of them and of its partial sums."""
    if bound < 2.0**52:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    if bound < 2.0**62:
        return queries @ vectors.T
    exact = queries.astype(object) @ vectors.T.astype(object)
    return np.clip(exact, -LIMIT - 1, LIMIT).astype(np.int64)


def coordinate_ranges(unit_queries: np.ndarray, cosines: np.ndarray, focus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest value of each focus coordinate in a unit vector whose cosine with the query is at least the
    given one."""
    q = np.take_along_axis(unit_queries, focus, axis=1)
    c = np.clip(cosines, 0.0, 1.0)[:, None]
    spread = np.sqrt((1 - c * c) * np.maximum(0.0, 1 - q * q))
    low = np.where(q < -c, -1.0, q * c - spread)
    high = np.where(q > c, 1.0, q * c + spread)
    return low - 1e-6, high + 1e-6


def choose_cut(cosines: np.ndarray, left: np.ndarray, long_enough: np.ndarray) -> float:
    """The local cosine from which pruning by coordinates costs less than by length: of all cuts the one with the least
    sum of candidates, where one that coordinate lists give counts four times (it is fetched, compared and multiplied alone)."""
    order = np.argsort(cosines)
    by_list, by_length = 4.0 * left[order] + 16.0, long_enough[order].astype(float)
    cost = np.concatenate([[0.0], np.cumsum(by_length)]) + np.concatenate([np.cumsum(by_list[::-1])[::-1], [0.0]])
    best = int(cost.argmin())
    return float(cosines[order][best]) if best < len(order) else np.inf


def search_block(q: dict, p: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vector place, product): for each query the up to k best products with this block that reach its
    threshold, all ties at the k-th place included only in order of vec_id. q and p hold row, vec_id, v, length; q also
    threshold (-inf: none)."""
    order = np.lexsort((p["vec_id"], -p["length"]))
    v, lengths, ids, rows = p["v"][order], p["length"][order], p["vec_id"][order], p["row"][order]
    longest = lengths[0]
    q_len, need = q["length"], q["threshold"]
    reach = q_len * longest
    alive = reach * (1 + MARGIN) + MARGIN >= need
    bound = float((q_len.max(initial=0.0) + 1) * (longest + 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        cosines = np.where((need > 0) & (reach > 0), need / reach, 0.0) * (1 - MARGIN)
        shortest = np.where((need > 0) & (q_len > 0), need / q_len, 0.0) * (1 - MARGIN)
    long_enough = np.searchsorted(-lengths, -shortest, side="right")
    listed = np.flatnonzero(alive & (cosines > 0))
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(at: int, candidates: np.ndarray, scores: np.ndarray) -> None:
        """The best k of one query, by product, then by vec_id."""
        fine = (scores >= need[at]) & (rows[candidates] != q["row"][at])
        candidates, scores = candidates[fine], scores[fine]
        if len(scores) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            candidates, scores = candidates[scores >= least], scores[scores >= least]
            best = np.lexsort((rows[candidates], ids[candidates], ~scores))[:k]  # ~ and not -, which would overflow
            candidates, scores = candidates[best], scores[best]
        parts.append((np.full(len(scores), at), candidates, scores))

    by_coordinates = np.zeros(len(q_len), bool)
    if len(listed):
        # a shorter vector needs an even higher cosine, so the bucket's local cosine bounds all of them
        unit = v / np.maximum(lengths, 1e-300)[:, None]
        unit_q = q["v"][listed] / q_len[listed][:, None]
        focus = np.argsort(-np.abs(unit_q), axis=1, kind="stable")[:, :FOCUS]
        low, high = coordinate_ranges(unit_q, cosines[listed], focus)
        lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        left = np.full(focus.shape, len(lengths))
        begin = np.zeros(focus.shape, np.int64)
        for f in np.unique(focus):
            by_value = np.argsort(unit[:, f], kind="stable")
            lists[int(f)] = (by_value, unit[by_value, f])
            at = np.nonzero(focus == f)
            begin[at] = np.searchsorted(lists[int(f)][1], low[at], side="left")
            left[at] = np.searchsorted(lists[int(f)][1], high[at], side="right") - begin[at]
        cut = choose_cut(cosines[listed], left.min(axis=1), long_enough[listed])
        for j in np.flatnonzero(cosines[listed] >= cut):
            at, f = int(listed[j]), int(left[j].argmin())
            by_coordinates[at] = True
            some = lists[int(focus[j, f])][0][begin[j, f] : begin[j, f] + max(0, left[j, f])]
            some = some[some < long_enough[at]]
            near = unit[np.ix_(some, focus[j])]
            some = some[((near >= low[j]) & (near <= high[j])).all(axis=1)]
            if len(some):
                keep(at, some, products(q["v"][at : at + 1], v[some], bound)[0])
    plain = np.flatnonzero(alive & ~by_coordinates)
    plain = plain[np.argsort(long_enough[plain], kind="stable")]
    for start in range(0, len(plain), AT_ONCE):
        some = plain[start : start + AT_ONCE]
        n = int(long_enough[some].max(initial=0))
        scores = products(q["v"][some], v[:n], bound)
        for r, at in enumerate(some):
            m = int(long_enough[at])
            keep(int(at), np.arange(m), scores[r, :m])
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    at, candidates, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
    return at, order[candidates], scores


def _meet(k: int):
    """The function of one block of queries and one of vectors."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([(n, pa.int64()) for n in ("query", "vec_id", "row", "score")])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        width = max(int(t["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for t in (left, right))
        q, p = (
            {"row": t["row"].to_numpy(), "length": t["length"].to_numpy(), "v": _matrix(t["v"], width), "vec_id": t["vec_id"].fill_null(LIMIT).to_numpy()} for t in (left, right)
        )
        q["threshold"] = left["threshold"].cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
        at, found, scores = search_block(q, p, k)
        return pa.table([pa.array(q["row"][at]), right["vec_id"].combine_chunks().take(pa.array(found)), pa.array(p["row"][found]), pa.array(scores)], schema=schema)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def _wave(queries: DataFrame, blocks: DataFrame, first: int, starts: list[int], ends: list[int], k: int, block: int) -> DataFrame:
    """Products of ``queries`` (with threshold and ``last``, the last bucket needed) with the buckets from ``first`` on.

    Blocks of queries are numbered by falling ``last``, so the blocks of vectors that a query needs and those of queries
    that a bucket needs are ranges of numbers, and a pair of blocks is a key that both sides name."""
    counts = {r["last"]: r["count"] for r in queries.filter(F.col("last") >= first).groupBy("last").count().collect()}  # at most a row a bucket
    own, begin, up_to, n = {}, {}, {}, 0
    for last in sorted(counts, reverse=True):
        begin[last], own[last] = n, -(-counts[last] // block)
        n += own[last]
    for b in range(first, len(ends)):
        up_to[b] = max((begin[x] + own[x] for x in counts if x >= b), default=0)
    number = lambda table, key: F.element_at(F.create_map(*[F.lit(int(x)) for pair in table.items() for x in pair]), key)
    if not n:
        return queries.sparkSession.createDataFrame([], FOUND)
    dealt = lambda of: F.pmod(F.xxhash64("row"), of)
    asked = queries.filter(F.col("last") >= first).withColumn("q", (number(begin, F.col("last")) + dealt(number(own, F.col("last")))).cast("int"))
    asked = asked.withColumn("p", F.explode(F.sequence(F.lit(starts[first]), number(dict(enumerate(ends)), F.col("last")) - 1)))
    given = blocks.filter((F.col("bucket") >= first) & F.col("bucket").isin([b for b, m in up_to.items() if m]))
    given = given.withColumn("q", F.explode(F.sequence(F.lit(0), number(up_to, F.col("bucket")) - 1)))
    asked, given = asked.select("q", "p", "row", "vec_id", "v", "length", "threshold"), given.select("q", F.col("block").alias("p"), "row", "vec_id", "v", "length")
    return asked.groupBy("q", "p").cogroup(given.groupBy("q", "p")).applyInArrow(_meet(k), FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, *, buckets: int = BUCKETS, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows of ``vectors`` (vec_id, embedding) with the highest inner
    product with each row for which the condition ``is_query`` holds; fewer if there are fewer.

    Components count as floor(scale * x). A row is no candidate of its own, but rows that repeat its vec_id are; each
    repeated query row has ranks of its own. Equal products rank by vec_id, a null one last. Vectors null or holding null
    or non-finite components take no part; an empty vector does, and where lengths differ missing components count as
    zero. Products are exact; one beyond the range of longs is set to its end. No query or no vector gives no rows;
    further columns are ignored."""
    rows = stored(whole_vectors(vectors, scale), "vectors")
    total = rows.count()
    n = int(min(buckets, max(1, total // least)))
    cuts = sorted(set(rows.agg(F.percentile_approx("length", [i / n for i in range(1, n)], 10 * buckets)).first()[0] or [] if n > 1 else []), reverse=True)
    lower = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    bucketed = rows.withColumn("bucket", F.size(F.filter(lower, lambda c: F.col("length") < c)))
    facts = {r["bucket"]: r for r in bucketed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect()}  # at most BUCKETS rows
    count = [facts[b]["n"] if b in facts else 0 for b in range(len(cuts) + 1)]
    longest = [facts[b]["longest"] if b in facts else 0.0 for b in range(len(cuts) + 1)]
    ends = np.cumsum([-(-c // block) for c in count]).tolist()
    starts = [0, *ends[:-1]]
    at = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("bucket") + 1)
    blocks = bucketed.withColumn("block", (at(starts) + F.pmod(F.xxhash64("row"), F.greatest(F.lit(1), at([-(-c // block) for c in count])))).cast("int"))
    first = next((b for b in range(len(count)) if sum(count[: b + 1]) >= FIRST * total), 0)

    asked = rows.filter(is_query).withColumn("threshold", F.lit(None).cast("double")).withColumn("last", F.lit(first))
    nearby = stored(_best(_wave(asked, blocks.filter(F.col("bucket") <= first), 0, starts, ends[: first + 1], k, block), k), "nearby")
    if first + 1 == len(count):
        found = nearby
    else:
        known = nearby.filter(F.col("rank") == k).select("query", F.col("score").cast("double").alias("threshold"))
        later = rows.filter(is_query).join(known.withColumnRenamed("query", "row"), "row", "left")
        reach = F.array(*[F.lit(float(x)) for x in longest])
        enough = F.filter(F.sequence(F.lit(first + 1), F.lit(len(count) - 1)), lambda b: F.col("threshold").isNull() | (F.get(reach, b) * F.col("length") * (1 + MARGIN) + MARGIN >= F.col("threshold")))
        later = stored(later.withColumn("last", F.coalesce(F.array_max(enough), F.lit(-1))), "queries")
        found = _best(nearby.drop("rank").unionByName(_wave(later, blocks, first + 1, starts, ends, k, block)), k)
    names = rows.filter(is_query).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return found.join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
