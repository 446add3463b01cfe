"""Quality of documents by weak supervision over simple rules, with DataFrame functions only.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts of vote patterns of all documents
(at most 3 to the number of rules, so a bounded table) estimates how often each rule gives each vote for good and for
bad documents, and the share of good ones. A document's posterior probability of being good follows from its votes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: What is believed of any rule before votes are seen: P(vote | good), P(vote | bad); and its weight against all documents.
BELIEF = {-1: (0.002, 0.3), 0: (0.05, 0.1), 1: (0.948, 0.6)}
STRENGTH = 0.1


def text_measures(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the measures that only rules use.

    Null and blank texts measure zero everywhere. Every row is measured by itself, in one pass without a shuffle."""
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.select("doc_id", "text", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("w"), lines.alias("lines"))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    last = F.size("w") - 3
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    measured = base.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        (F.length("text") - count(r"[\x20\x09-\x0D]")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        count(r"[#*$%&|<>]+").alias("n_symbol_runs"),
        count(r"[^\p{L}\p{N}\x20\x09-\x0D]").alias("n_other"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        count("[A-Z]").alias("n_upper"),
        count("[!?]").alias("n_marks"),
        F.when(last < 0, F.array().cast("array<bigint>")).otherwise(hashes).alias("h"),
    )
    kept = [c for c in measured.columns if c != "h"]
    # only where some window repeats are windows sorted, so that equal ones become neighbours
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    placed = F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    ordered = measured.select(*kept, F.when(repeats, F.array_sort(placed)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("s"))
    same = lambda x, j: (x["h"] == F.get("s", j + 1)["h"]) | (x["h"] == F.get("s", j - 1)["h"])
    at = F.array_sort(F.transform(F.filter("s", lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))
    found = ordered.select(*kept, at.alias("at"))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("at", start, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    return found.select(*kept, covered.cast("long").alias("n_repeat_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rule_votes() -> dict[str, Column]:
    """Votes by name: 1 good, -1 bad, 0 abstains. On documents without words all but the repeat rules abstain. Short
    documents are the base law's matter, so no rule votes on length."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    some = F.col("n_words") > 0
    share = lambda c, of: F.col(c) / of
    return {
        "word_length": _vote(some & share("word_chars", n).between(3.0, 8.5), some & ~share("word_chars", n).between(2.5, 12.0)),
        "symbols": _vote(some & (share("n_symbols", n) < 0.02), share("n_symbols", n) > 0.2),
        "symbol_runs": _vote(some & (share("n_symbol_runs", n) < 0.02), share("n_symbol_runs", n) > 0.15),
        "letters": _vote(some & (share("n_other", chars) < 0.08), share("n_other", chars) > 0.13),
        "dup_lines": _vote((F.col("n_lines") > 3) & (F.col("n_dup_lines") == 0), share("n_dup_lines", lines) > 0.5),
        "repeats": _vote(some & (share("n_repeat_words", n) < 0.15), share("n_repeat_words", n) > 0.35),
        "upper": _vote(some & (share("n_upper", chars) < 0.1), share("n_upper", chars) > 0.3),
        "marks": _vote(some & (share("n_marks", n) < 0.05), share("n_marks", n) > 0.2),
    }


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over (votes, count): share of good documents, and for each rule P(vote | good), P(vote | bad).

    Documents with any vote for bad start as bad. ``BELIEF`` enters every estimate like ``STRENGTH`` times the documents
    seen: rules seldom call a good document bad, but a bad one breaks few of them. Without it, a kind of bad document
    that breaks one rule only would pass for good."""
    n_rules = len(patterns[0][0]) if patterns else 0
    post = [0.02 if -1 in v else 0.98 for v, _ in patterns]
    prior, rates = 0.5, [{v: (1 / 3, 1 / 3) for v in (-1, 0, 1)} for _ in range(n_rules)]
    for _ in range(rounds):
        good = sum(p * c for p, (_, c) in zip(post, patterns, strict=True))
        total = sum(c for _, c in patterns)
        held = STRENGTH * total + 1
        prior = (good + 1) / (total + 2)
        for r in range(n_rules):
            sums = {v: [held * g, held * b] for v, (g, b) in BELIEF.items()}
            for p, (votes, c) in zip(post, patterns, strict=True):
                sums[votes[r]][0] += p * c
                sums[votes[r]][1] += (1 - p) * c
            rates[r] = {v: (s[0] / (good + held), s[1] / (total - good + held)) for v, s in sums.items()}
        post = []
        for votes, _ in patterns:
            z = math.log(prior / (1 - prior)) + sum(math.log(rates[r][v][0] / rates[r][v][1]) for r, v in enumerate(votes))
            post.append(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))
    return prior, rates


def quality_verdicts(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed, quality (posterior probability) and kept for every row of ``docs``.

    base_failed: under 50 words, or over half of the words in repeated windows; such documents are not kept. Null and
    empty texts fail so. Repeated rows count each; an empty table gives no rows; columns besides doc_id and text are
    ignored."""
    measured = stored(text_measures(docs), "measures")
    votes = rule_votes()
    counted = measured.groupBy(*[v.alias(k) for k, v in votes.items()]).count().collect()
    prior, rates = fit_label_model(sorted((tuple(r)[:-1], r["count"]) for r in counted))
    z = F.lit(math.log(prior / (1 - prior)))
    for (_, vote), rate in zip(votes.items(), rates, strict=False):
        weight = {v: math.log(g / b) for v, (g, b) in rate.items()}
        z = z + F.when(vote == 1, weight[1]).when(vote == -1, weight[-1]).otherwise(weight[0])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-z)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
