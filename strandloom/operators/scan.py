"""Ordered scans of one long sequence by many tasks: blocks, summaries of blocks that compose, and what is carried into each.

A key (a structure, a chain, a segment) may hold most of all rows. Its rows are cut into blocks by their order, so a task sorts
and scans one block at a time; a block's summary is one row, and a scan over summaries gives what each block starts from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block at most, where orders are unique: blocks are ranges of the order. Blocks of products are shorter, as one is an array.
BLOCK, PRODUCTS = 8192, 64
_SUMMARY = {
    "sum": lambda v, at: F.sum(v), "min": lambda v, at: F.min(v), "max": lambda v, at: F.max(v),
    "last": lambda v, at: F.max_by(v, F.when(v.isNotNull(), at)), "first": lambda v, at: F.min_by(v, F.when(v.isNotNull(), at)),
}
_OVER = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda v: F.last(v, ignorenulls=True), "first": lambda v: F.first(v, ignorenulls=True)}
_JOIN = {
    "sum": lambda carried, own: F.coalesce(carried, F.lit(0)) + F.coalesce(own, F.lit(0)), "min": F.least, "max": F.greatest,
    "last": lambda carried, own: F.coalesce(own, carried), "first": F.coalesce,
}


def running(rows: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]], whole: dict[str, tuple[str, Column]] | None = None, inclusive: bool = True, block: int | None = None) -> DataFrame:
    """``rows`` with the running ``values`` along ``order`` (a whole number) within ``keys``, and ``whole`` ones of all rows of
    the keys. A value is (kind, column), where kind is sum, min, max, last or first; the last two pass over nulls.

    The current row counts if ``inclusive``. Rows of equal order are in no order among themselves. ``rows`` are read twice, once
    for the summaries."""
    own = rows.withColumn("__block", F.floor(F.col(order) / (block or BLOCK)))
    for n, (_, v) in (values | (whole or {})).items():
        own = own.withColumn(f"__{n}", v)
    groups = own.groupBy(*keys, "__block").agg(*[_SUMMARY[k](F.col(f"__{n}"), F.col(order)).alias(f"__{n}") for n, (k, _) in (values | (whole or {})).items()])
    of = Window.partitionBy(*keys)
    before = of.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    throughout = of.orderBy("__block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = [_OVER[k](F.col(f"__{n}")).over(before).alias(f"__carried_{n}") for n, (k, _) in values.items()]
    carried += [_OVER[k](F.col(f"__{n}")).over(throughout).alias(n) for n, (k, _) in (whole or {}).items()]
    groups = groups.select(*keys, "__block", F.lit(True).alias("__head"), *carried)
    # what is carried in is one more row of the block, ahead of the others: a join would move all rows once more
    met = own.unionByName(groups, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "__block").orderBy(F.desc_nulls_last("__head"), order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    given = inside.rowsBetween(Window.unboundedPreceding, 0)
    sums = [_OVER[k](F.col(f"__{n}")).over(so_far).alias(f"__own_{n}") for n, (k, _) in values.items()]
    heads = [F.first(c).over(given).alias(f"__at_{c}") for c in (*[f"__carried_{n}" for n in values], *(whole or {}))]
    joined = met.select(*rows.columns, "__head", *sums, *heads).filter(F.col("__head").isNull())
    got = [_JOIN[k](F.col(f"__at___carried_{n}"), F.col(f"__own_{n}")).alias(n) for n, (k, _) in values.items()]
    return joined.select(*rows.columns, *got, *[F.col(f"__at_{n}").alias(n) for n in whole or {}])


def number(rows: DataFrame, keys: list[str], order: str, name: str, block: int | None = None) -> DataFrame:
    """``rows`` with their place (from 0) along ``order``, which is unique within ``keys``."""
    return running(rows, keys, order, {name: ("sum", F.lit(1))}, inclusive=False, block=block).withColumn(name, F.col(name).cast("int"))


def products(rows: DataFrame, keys: list[str], at: str, value: str, times: Callable[[Column, Column], Column], block: int | None = None) -> DataFrame:
    """``rows`` with ``value`` replaced by the product of all values from the key's first row to this one.

    ``at`` numbers the rows of a key from 0 without gaps. ``times(later, earlier)`` is any associative product, not necessarily
    commutative. Each level works on blocks of so many values; their totals are the next level, until a key has one block."""
    size = block or PRODUCTS
    cut = rows.withColumn("__block", F.floor(F.col(at) / size))
    lists = cut.groupBy(*keys, "__block").agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("v")))).alias("l"))
    each = F.transform("l", lambda x: x["v"])
    grown = F.aggregate(F.slice(each, 2, size), F.slice(each, 1, 1), lambda so_far, v: F.concat(so_far, F.array(times(v, F.element_at(so_far, -1)))))
    lists = lists.select(*keys, "__block", F.transform("l", lambda x: x["at"]).alias("at"), grown.alias("v"))
    if not rows.filter(F.col(at) >= size).isEmpty():
        totals = products(lists.select(*keys, F.col("__block").alias("block_no"), F.element_at("v", -1).alias("total")), keys, "block_no", "total", times, size)
        totals = totals.select(*keys, (F.col("block_no") + 1).alias("__block"), F.col("total").alias("before"))
        lists = lists.join(totals, [*keys, "__block"], "left")
        v = F.when(F.col("before").isNull(), F.col("v")).otherwise(F.transform("v", lambda x: times(x, F.col("before"))))
        lists = lists.withColumn("v", v)
    found = lists.select(*keys, F.explode(F.arrays_zip("at", "v")).alias("x")).select(*keys, F.col("x.at").alias(at), F.col("x.v").alias(value))
    return rows.drop(value).join(found, [*keys, at])
