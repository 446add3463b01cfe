"""Toxic documents by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Voters are the given lexicon, words and word beginnings that go with toxic labels in at most ``max_rows`` labelled
documents (each fires from a number of hits on), and patterns over all hits (how many, how dense, none). All documents
vote, and the label model is fitted to the table of their vote patterns: a tree-structured Bayes model, in which each
voter depends on the hidden class and on one other voter. So it estimates how well voters tell the classes apart and how
far they only repeat each other. Labels give its start and enter estimates like ``STRENGTH`` times the documents, except
for the voters that they chose themselves.
A linear classifier is trained on the posterior labels of all patterns and scores every document.

Patterns stay distributed: each round of fitting is one aggregation of moments, whose size hangs on the voters alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, drop_stored, stored
from .decontaminate import norm_words
from .embed_classifier import labelled_sample

MAX_ROWS = 8000
#: Insults that vote whether or not labels show them; English, German, French, Spanish.
LEXICON = (
    "idiot moron scum trash worthless pathetic disgusting stupid clown loser "
    "vollidiot schwachkopf abschaum dummkopf trottel widerlich versager arschloch "
    "imbécile crétin connard abruti ordure débile minable "
    "imbécil estúpido idiota basura escoria payaso patético asqueroso"
).split()
PREFIXES = (3, 4, 5, 6, 7)
#: A found voter fires from this many hits on.
LEVELS = (1, 2, 3)
MIN_TOXIC = 2
#: Voters are found as long as those that chance adds stay below this share of them, or below this number a level.
FALSE_SHARE, FALSE_FINDS = 0.1, 8.0
#: Patterns over the hits of all voters' terms: at least so many, at least one in so many words; none at all comes last.
HITS, DENSE = (1, 2, 3, 4, 6, 9), (200, 100, 50, 25)
N_PATTERNS = len(HITS) + len(DENSE) + 1
STRENGTH = 1.0
SMOOTH = 2.0
ROUNDS, STEPS, RIDGE = 12, 8, 1e-3

Voters = tuple[tuple[str, int], ...]


@lru_cache(maxsize=2)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, v in enumerate(terms):
        # a beginning ends in "*": it stands after a space; a word stands between spaces
        found.add_word((" " + v[:-1] if v.endswith("*") else f" {v} ").encode().decode("latin-1"), k)
    if terms:
        found.make_automaton()
    return found


def term_counts(text: str | None, terms: tuple[str, ...]) -> tuple[np.ndarray, int]:
    """How often each term matches, and the number of words. Words are runs of letters, digits and non-ASCII, in lower case."""
    parts = norm_words((text or "").lower())
    counts = np.zeros(len(terms), np.int64)
    if parts and terms:
        joined = (b" " + b" ".join(parts) + b" ").decode("latin-1")
        for _, k in _automaton(terms).iter(joined):
            counts[k] += 1
    return counts, len(parts)


@lru_cache(maxsize=2)
def _split(voters: Voters) -> tuple[tuple[str, ...], np.ndarray, np.ndarray]:
    """Distinct terms, and the term and level of each voter."""
    terms = tuple(dict.fromkeys(t for t, _ in voters))
    return terms, np.array([terms.index(t) for t, _ in voters], np.int64), np.array([n for _, n in voters], np.int64)


def votes(text: str | None, voters: Voters) -> np.ndarray:
    """1 where a voter or a pattern fires; the last pattern, no hits at all, speaks for a clean document."""
    terms, of, least = _split(voters)
    counts, n_words = term_counts(text, terms)
    hits = int(counts.sum())
    patterns = [hits >= h for h in HITS] + [hits > 0 and d * hits >= n_words for d in DENSE] + [hits == 0]
    return np.concatenate([counts[of] >= least, patterns]).astype(np.uint8)


def chance(t: int, n: int, q: float) -> float:
    """P(at least t of n) where each is toxic with probability q."""
    return min(1.0, sum(math.comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(t, n + 1)) if n < 500 else math.exp(-2 * n * max(0.0, t / n - q) ** 2))


def telling(cells: list[tuple[int, int, int]], q: float) -> dict[tuple[int, int], float]:
    """(toxic, clean) counts that are no chance, with their probability by chance, of ``cells`` (toxic, clean, names that
    have these counts): as many as ``FALSE_SHARE`` and ``FALSE_FINDS`` allow."""
    p = sorted((chance(t, t + c, q), t, c, n) for t, c, n in cells)
    total, seen, last = sum(n for *_, n in p), 0, 0
    for at, (x, _, _, n) in enumerate(p, 1):
        seen += n
        if x * total <= max(FALSE_SHARE * seen, FALSE_FINDS):
            last = at
    return {(t, c): x for x, t, c, _ in p[:last]}


def discover_voters(rows: DataFrame) -> Voters:
    """The lexicon, and words and beginnings that go with the toxic among ``rows`` (label, text), from 1, 2 or 3 hits on.

    Toxic rows in which a word first stands between the same two words count once, so copies prove nothing. Of beginnings
    and words that continue each other only the most telling one votes. No other bound cuts the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, out, hits, place = [], [], [], []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen: dict[str, list[int]] = {}
                parts = [p.decode() for p in norm_words((text or "").lower())]
                for i, w in enumerate(parts):
                    for name in (w, *(w[:n] + "*" for n in PREFIXES if len(w) > n)):
                        seen.setdefault(name, [0, i])[0] += 1
                out += seen
                hits += (n for n, _ in seen.values())
                place += (zlib.crc32(" ".join(parts[max(0, i - 1) : i] + parts[i + 1 : i + 2]).encode()) for _, i in seen.values())
                toxic += [y] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(out, pa.string()), pa.array(hits, pa.int64()), pa.array(place, pa.int64())], ["label", "name", "hits", "place"])

    size = rows.agg(F.sum("label"), F.count("*")).first()
    toxic, clean = (size[0] or 0), size[1] - (size[0] or 0)
    chosen = [(w, 1) for w in LEXICON]
    if not toxic:
        return tuple(chosen)
    fires = lambda y, n: (F.col("label") == y) & (F.col("hits") >= n)
    at = [F.struct(F.lit(n).alias("level"), F.size(F.collect_set(F.when(fires(1, n), F.col("place")))).alias("t"), F.count_if(fires(0, n)).cast("int").alias("c")) for n in LEVELS]
    names = rows.mapInArrow(run, "label int, name string, hits long, place long").groupBy("name").agg(F.array(*at).alias("l"))
    names = stored(names.select("name", F.inline("l")).filter(F.col("t") >= MIN_TOXIC), "names")
    cells: dict[int, list] = {}
    for level, t, c, n in names.groupBy("level", "t", "c").count().collect():  # counts up to max_rows
        cells.setdefault(level, []).append((t, c, n))
    found = [(x, level, t, c) for level, some in cells.items() for (t, c), x in telling(some, toxic / (toxic + clean)).items()]
    if found:
        best: dict[str, tuple] = {}
        good = rows.sparkSession.createDataFrame([(level, t, c, float(x)) for x, level, t, c in found], "level int, t int, c int, p double")
        for r in names.join(F.broadcast(good), ["level", "t", "c"]).select("name", "level", "p").collect():  # a small share of the words of max_rows texts
            best[r["name"]] = min(best.get(r["name"], (2.0,)), (r["p"], len(r["name"]), r["name"], r["level"]))
        for _, _, name, least in sorted(best.values()):
            stem, open_end = name.rstrip("*"), name.endswith("*")
            if not any(c == name or c.endswith("*") and stem.startswith(c[:-1]) or open_end and c.startswith(stem) for c, _ in chosen):
                chosen += [(name, least), (name, least + 1)]
    drop_stored(names)
    return tuple(chosen)


def moments(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted sums of v_i v_j, for each column of ``w``, with a constant voter in front: shape (classes, k + 1, k + 1)."""
    x = np.hstack([np.ones((len(v), 1)), v])
    return np.stack([x.T @ (x * w[:, [c]]) for c in range(w.shape[1])])


def tree(m: np.ndarray) -> np.ndarray:
    """Parent of each voter (-1 for the first) in the tree of greatest mutual information given the class."""
    k = m.shape[1] - 1
    info = np.zeros((k, k))
    for c in range(len(m)):
        n = m[c, 0, 0] + 1e-9
        one = np.diag(m[c])[1:] / n
        both = m[c, 1:, 1:] / n
        for a in (0, 1):
            for b in (0, 1):
                p = both if a and b else one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both
                q = np.outer(one if a else 1 - one, one if b else 1 - one)
                p = np.maximum(p, 0)
                info += n * np.where((p > 1e-12) & (q > 1e-12), p * np.log(np.maximum(p, 1e-12) / np.maximum(q, 1e-12)), 0)
    parent = np.full(k, -1)
    reach, best = np.zeros(k, int), info[0].copy() if k else np.zeros(0)
    inside = np.zeros(k, bool)
    inside[:1] = True
    for _ in range(k - 1):
        j = int(np.argmax(np.where(inside, -np.inf, best)))
        parent[j], inside[j] = reach[j], True
        closer = info[j] > best
        best[closer], reach[closer] = info[j][closer], j
    return parent


def label_model(m: np.ndarray, found: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior odds (log), parents, and P(v_i | v_parent, class) by class, value of the parent and voter, from ``moments``.

    Voters that ``found`` marks take their part from the moments ``own``. Small counts lean on the rate of both classes."""
    parent = tree(m)
    k = len(parent)
    cond = np.zeros((2, 2, k))
    for i, p in enumerate(parent):
        use = m if found is None or not found[i] else own
        rate = (use[:, 1 + i, 1 + i].sum() + 0.5) / (use[:, 0, 0].sum() + 1)
        for c in range(2):
            n, one = use[c, 0, 0], use[c, 1 + i, 1 + i]
            lean = (one + SMOOTH * rate) / (n + SMOOTH)
            both, with_parent = (use[c, 1 + i, 1 + p], use[c, 1 + p, 1 + p]) if p >= 0 else (0.0, 0.0)
            cond[c, 1, i] = (both + SMOOTH * lean) / (with_parent + SMOOTH)
            cond[c, 0, i] = (one - both + SMOOTH * lean) / (n - with_parent + SMOOTH)
    return float(np.log((m[1, 0, 0] + 1) / (m[0, 0, 0] + 1))), parent, np.clip(cond, 1e-9, 1 - 1e-9)


def posterior(v: np.ndarray, model: tuple[float, np.ndarray, np.ndarray]) -> np.ndarray:
    """P(toxic | votes); class 1 of the model is the toxic one."""
    odds, parent, cond = model
    of = np.where(parent >= 0, v[:, parent], 0)
    p = np.where(of == 1, cond[:, 1][:, None, :], cond[:, 0][:, None, :])
    p = np.where(v == 1, p, 1 - p)
    return 1 / (1 + np.exp(-np.clip(odds + np.log(p[1] / p[0]).sum(axis=1), -40, 40)))


def _unpack(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    counts = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2, 3)], axis=1)
    return np.unpackbits(raw, axis=1, count=k), counts


def _summed(patterns: DataFrame, k: int, of: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all patterns of ``of(votes, counts)``, an array of ``size``.

    All partitions work at once, and their arrays are added up in tasks before the driver gets the last few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                total += of(*_unpack(part, k)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    arrays = patterns.mapInArrow(run, "total binary").rdd.map(lambda row: np.frombuffer(row[0]))
    return np.zeros(size) + arrays.treeReduce(np.add, 2)


def fit_label_model(summed: Callable[[Callable, int], np.ndarray], found: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray] | None:
    """Expectation-maximisation; ``summed(f, size)`` adds f(votes, counts) over all patterns, with counts of documents
    without label, of those labelled clean and of those labelled toxic. None without both labels.

    ``found`` marks the voters that were chosen by the labels; what labels say of them is too good, so after the start
    their accuracy is estimated from the other documents alone."""
    k = len(found)
    size = 2 * (k + 1) * (k + 1)
    given = summed(lambda v, n: moments(v, n[:, 1:]), size).reshape(2, k + 1, k + 1)
    labelled = given[:, 0, 0].sum()
    if not (given[0, 0, 0] and given[1, 0, 0]):
        return None
    weight = max(1.0, STRENGTH * summed(lambda v, n: n[:, :1].sum(), 1)[0] / labelled)
    model = label_model(given)
    for _ in range(rounds):

        def expected(v, n, model=model):
            p = posterior(v, model)[:, None]
            return moments(v, n[:, :1] * np.hstack([1 - p, p]))

        own = summed(expected, size).reshape(2, k + 1, k + 1)
        if not own[:, 0, 0].sum():
            break
        model = label_model(own + weight * given, found, own)
    return model


def fit_linear(summed: Callable[[Callable, int], np.ndarray], k: int, model, steps: int = STEPS) -> np.ndarray:
    """Weights (bias first) of the logistic regression on posterior labels, by Newton steps over all patterns."""
    w = np.zeros(k + 1)
    for _ in range(steps):

        def parts(v, n, w=w):
            x = np.hstack([np.ones((len(v), 1)), v])
            n = n.sum(axis=1)
            s = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            g = x.T @ (n * (s - posterior(v, model)))
            return np.concatenate([[n.sum()], g, (x.T @ (x * (n * s * (1 - s))[:, None])).ravel()])

        got = summed(parts, 1 + (k + 1) + (k + 1) ** 2)
        n, g, h = got[0], got[1 : k + 2], got[k + 2 :].reshape(k + 1, k + 1)
        keep = RIDGE * n * np.eye(k + 1)
        keep[0, 0] = 1e-9 * n
        step = np.linalg.solve(h + keep + 1e-9 * np.eye(k + 1), g + keep @ w)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
    return w


def train(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, max_rows: int = MAX_ROWS) -> tuple[Voters, np.ndarray]:
    """Voters and the weights of the linear classifier, bias first. Without labels of both kinds hits alone count."""
    sample = labelled_sample(labels, label, held_out, max_rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id")
    # rows that repeat an id do not widen the sample: one text of each of at most max_rows labelled rows
    rows = stored(rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text"), "labelled")
    voters = discover_voters(rows)
    drop_stored(rows)

    def vote_patterns(voters: Voters) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [np.packbits(votes(t, voters)).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(0)], ["pattern", "doc_id"])

        id_type = docs.schema["doc_id"].dataType.simpleString()
        voted = texts.mapInArrow(run, f"pattern binary, doc_id {id_type}").join(F.broadcast(sample), "doc_id", "left")
        counts = [F.count_if(F.col("label").isNull()).alias("n"), F.count_if(F.col("label") == 0).alias("clean"), F.count_if(F.col("label") == 1).alias("toxic")]
        return stored(voted.groupBy("pattern").agg(*counts), "patterns")

    patterns, k = vote_patterns(voters), len(voters) + N_PATTERNS
    summed = lambda of, size: _summed(patterns, k, of, size)
    model = fit_label_model(summed, np.array([v[0] not in LEXICON for v in voters] + [False] * N_PATTERNS))
    if model is None:
        weights = np.concatenate([[-1.0], np.full(len(voters), 0.5), np.full(N_PATTERNS - 1, 0.5), [-2.0]])
    else:
        weights = fit_linear(summed, k, model)
    drop_stored(patterns)
    return voters, weights


def score(docs: DataFrame, model: tuple[Voters, np.ndarray], keep_below: float | None = None) -> DataFrame:
    """doc_id, score for every row; or, with ``keep_below``, the rows of ``docs`` that score less."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs if keep_below is not None else docs.select("doc_id", F.col("text").cast("string").alias("text"))
    at = docs.columns.index("text")
    schema = docs.schema if keep_below is not None else f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, w = sent.value
        for batch in batches:
            scores = np.array([1 / (1 + np.exp(-np.clip(w[0] + w[1:] @ votes(t, voters), -40, 40))) for t in batch.column(at).to_pylist()], dtype=float)
            if keep_below is not None:
                yield batch.filter(pa.array(scores < keep_below, pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 2, folds: int = 4, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Only the text enters a score; labels come from rows outside the held-out fold. Without labels only the lexicon
    votes. Null and empty texts have no hits. Null ids count as the empty text for the fold; of the texts that share a labelled
    id one is learned from; repeated rows score alike; an empty table gives no rows; other columns are ignored."""
    held = crc32_of_id(F.col("doc_id")) % folds == fold
    model = train(docs, labels, label, held, max_rows)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 2, folds: int = 4, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns, by the model of ``toxicity``."""
    held = crc32_of_id(F.col("doc_id")) % folds == fold
    return score(docs, train(docs, labels, label, held, max_rows), keep_below=threshold)
