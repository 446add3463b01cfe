"""How far the sources of a language differ in their words, by wide term vectors.

Each language keeps the terms that stand in at least ``min_docs`` of its documents. A kept term becomes one row with an
array of its occurrences by source (the sources of a language are numbered). Higher-order functions turn that array into
smoothed shares and emit one contribution for each pair of sources, which are summed before they are shuffled. All
arithmetic is exact: shares are whole parts in 10^9, divided as decimals.

Only the cutting and first counting of words runs in Python, a batch of documents at a time; sums by language, source and
term follow before the shuffle. So a frequent word or a source with a third of all documents is a few rows from each task. A language of S sources and V terms costs V * S * (S - 1) / 2 differences, which no
task holds at once."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MIN_DOCS = 30
SMOOTHING = 5
PARTS = 1_000_000_000
TOP_TERMS = 50
#: Tables of one row a group or language are broadcast up to so many groups (about 100 bytes each), else joined by a shuffle.
BROADCAST_GROUPS = 50_000
#: UTF-8 bytes: A-Z become a-z, other ASCII but a-z separates terms, bytes of further characters stay.
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
COUNTS = ["lang", "source", "term", "n", "df"]


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents), summed within each Arrow batch; parts of a sum, to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: defaultdict[tuple, Counter] = defaultdict(Counter)
            df: defaultdict[tuple, Counter] = defaultdict(Counter)
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode().translate(FOLD).split()
                n[lang, source].update(words)
                df[lang, source].update(set(words))
            for (lang, source), terms in n.items():
                names = pa.array(list(terms), pa.binary()).cast(pa.string())
                held = pa.array(list(map(df[lang, source].__getitem__, terms)), pa.int64())
                same = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, names, pa.array(list(terms.values()), pa.int64()), held], COUNTS)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, df long")


def _share(count: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * n_terms)), exact also beyond the range of longs."""
    over = F.lit(PARTS).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(20,0)")
    under = (total + SMOOTHING * n_terms).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", over, under)


def _dense(entries: Column, size: Column) -> Column:
    """The array of ``size`` counts from (k, n) in order of k; places without an entry hold 0."""
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n.cast("int"))
    after = lambda i: F.when(i == 0, 0).otherwise(F.get(entries, i - 1)["k"] + 1)  # noqa: E731 
    filled = F.flatten(F.transform(entries, lambda e, i: F.concat(zeros(e["k"] - after(i)), F.array(e["n"]))))
    return F.concat(filled, zeros(size - F.element_at(entries, -1)["k"] - 1))


def _pairs(items: Column, f) -> Column:
    """f(items[i], items[j]) for all i < j, in order."""
    rest = lambda i: F.slice(items, i + 2, F.size(items))
    return F.flatten(F.transform(items, lambda x, i: F.transform(rest(i), lambda y: f(x, y))))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank.

    ``pair``: each other source of the language, with the sum of differences over all kept terms. ``term``: the
    ``top_terms`` kept terms by which the source lies most above its language. Null text, lang and source count as empty;
    every row is a document, also where rows repeat; a group without terms still has its pairs, and a language without kept
    terms has pairs of value 0. Equal values rank by item. A language of one source has no pairs. No document gives no row;
    columns besides text, lang and source are ignored."""
    known = {"lang": "string", "source": "string", "text": "string"}
    docs = docs.select(*[F.coalesce(F.col(c).cast(t), F.lit("")).alias(c) for c, t in known.items()])
    order = Window.partitionBy("lang").orderBy("source")
    groups = stored(docs.groupBy("lang", "source").agg(F.count("*").alias("n_docs")).withColumn("k", F.row_number().over(order) - 1), "groups")
    small = groups.count() <= BROADCAST_GROUPS
    hint = F.broadcast if small else lambda df: df

    counted = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).join(hint(groups.select("lang", "source", "k")), ["lang", "source"])
    kept = counted.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("entries"), F.sum("df").alias("df")).filter(F.col("df") >= min_docs)
    sizes = groups.groupBy("lang").agg(F.count("*").alias("s"), F.transform(F.array_sort(F.collect_list(F.struct("k", "source"))), lambda x: x["source"]).alias("sources"))
    kept = stored(kept.select("lang", "term", "entries"), "kept")

    per_source = kept.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.k").alias("k")).agg(F.sum("e.n").alias("n"))
    totals = per_source.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("by_source"), F.sum("n").alias("lang_total"))
    langs = totals.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang").join(sizes, "lang").select("lang", "sources", "s", "v", "lang_total", _dense(F.col("by_source"), F.col("s")).alias("totals"))
    langs = stored(langs, "langs")

    wide = kept.join(hint(langs), "lang").select("lang", "term", "sources", "v", "totals", "lang_total", _dense(F.col("entries"), F.col("s")).alias("counts"))
    shares = F.zip_with("counts", "totals", lambda c, n: _share(c, n, F.col("v")))
    whole = _share(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c), F.col("lang_total"), F.col("v"))
    wide = stored(wide.select("lang", "term", "counts", shares.alias("p"), whole.alias("q")), "wide")

    sums = wide.select("lang", F.posexplode(_pairs(F.col("p"), lambda x, y: F.abs(x - y))).alias("pos", "d")).groupBy("lang", "pos").agg(F.sum("d").alias("value"))
    pairs = sizes.select("lang", F.posexplode(_pairs(F.col("sources"), lambda x, y: F.struct(x.alias("a"), y.alias("b")))).alias("pos", "pair"))
    pairs = pairs.join(sums, ["lang", "pos"], "left").select("lang", "pair", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    both = F.array(F.struct(F.col("pair.a").alias("source"), F.col("pair.b").alias("item")), F.struct(F.col("pair.b").alias("source"), F.col("pair.a").alias("item")))
    pairs = pairs.select("lang", F.explode(both).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    above = F.filter(F.zip_with(F.sequence(F.lit(0), F.size("p") - 1), F.arrays_zip("counts", "p"), lambda k, x: F.struct(k.alias("k"), x["counts"].alias("n"), (x["p"] - F.col("q")).alias("value"))), lambda x: (x["n"] > 0) & (x["value"] > 0))
    terms = wide.select("lang", "term", F.explode(above).alias("x")).select("lang", F.col("x.k").alias("k"), F.col("term").alias("item"), F.col("x.value").alias("value"))
    place = Window.partitionBy("lang", "k").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top_terms)
    terms = terms.join(hint(groups.select("lang", "source", "k")), ["lang", "k"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.unionByName(terms)
