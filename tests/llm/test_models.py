"""The trained parts and the suffix array against plain versions of the same definitions."""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandloom.llm import embed_classifier, pagetext, quality_rules, sharding, toxicity
from strandloom.llm.common import table


def random_votes(n=400, k=5, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.2
    v = rng.random((n, k)) < np.where(y[:, None], 0.7, 0.1)
    v[:, 1] = np.where(rng.random(n) < 0.9, v[:, 0], v[:, 1])  # says what voter 0 says
    return y, v.astype(np.uint8)


def test_moments_are_sums():
    _, v = random_votes(50, 4)
    w = np.random.default_rng(0).random((50, 2))
    got = toxicity.moments(v, w)
    for c, i, j in product(range(2), range(5), range(5)):
        x = np.hstack([np.ones((50, 1)), v])
        assert got[c, i, j] == pytest.approx(sum(w[n, c] * x[n, i] * x[n, j] for n in range(50)))


def test_tree_is_the_best_spanning_tree():
    y, v = random_votes()
    m = toxicity.moments(v, np.stack([~y, y], axis=1).astype(float))

    def information(i, j):
        total = 0.0
        for c in range(2):
            rows = v[y == c]
            for a, b in product((0, 1), repeat=2):
                p = np.mean((rows[:, i] == a) & (rows[:, j] == b))
                q = np.mean(rows[:, i] == a) * np.mean(rows[:, j] == b)
                total += len(rows) * p * np.log(p / q) if p > 0 else 0
        return total

    edges = list(combinations(range(5), 2))
    best = -1.0
    for some in combinations(edges, 4):
        root = list(range(5))
        find = lambda x: x if root[x] == x else find(root[x])  # noqa: B023, E731
        for a, b in some:
            root[find(a)] = find(b)
        if len({find(x) for x in range(5)}) == 1:
            best = max(best, sum(information(*e) for e in some))
    parent = toxicity.tree(m)
    assert sum(information(i, p) for i, p in enumerate(parent) if p >= 0) == pytest.approx(best) and (parent >= 0).sum() == 4


def test_posterior_is_bayes():
    y, v = random_votes()
    odds, parent, cond = model = toxicity.label_model(toxicity.moments(v, np.stack([~y, y], axis=1).astype(float)))
    got = toxicity.posterior(v, model)
    for n in range(0, 400, 37):
        p = [1.0, float(np.exp(odds))]
        for c in range(2):
            for i, q in enumerate(parent):
                one = cond[c, v[n, q] if q >= 0 else 0, i]
                p[c] *= one if v[n, i] else 1 - one
        assert got[n] == pytest.approx(p[1] / (p[0] + p[1]))


def test_expectation_maximisation_over_patterns_is_that_over_documents(monkeypatch):
    """Counts of patterns give what one row a document gives, and the model finds the classes with few labels."""
    y, v = random_votes(3000)
    label = np.full(3000, -1)
    label[:100] = y[:100]
    each = np.stack([label == -1, label == 0, label == 1], axis=1).astype(float)
    patterns, of = np.unique(v, axis=0, return_inverse=True)
    counts = np.stack([np.bincount(of.ravel(), each[:, c]) for c in range(3)], axis=1)
    found = np.array([False, True, False, False, True])
    one = toxicity.fit_label_model(lambda f, size: f(v, each).ravel(), found)
    two = toxicity.fit_label_model(lambda f, size: f(patterns, counts).ravel(), found)
    assert one[0] == pytest.approx(two[0]) and np.allclose(one[2], two[2]) and (one[1] == two[1]).all()
    assert np.mean((toxicity.posterior(v, one) > 0.5) == y) > 0.9
    w = toxicity.fit_linear(lambda f, size: f(patterns, counts).ravel(), 5, two)
    assert np.mean((v @ w[1:] + w[0] > 0) == y) > 0.9


def test_no_labels_of_a_kind_give_no_model():
    v = np.ones((3, 2), np.uint8)
    assert toxicity.fit_label_model(lambda f, size: f(v, np.array([[1.0, 1.0, 0.0]] * 3)).ravel(), np.zeros(2, bool)) is None


def test_chance():
    assert toxicity.chance(0, 9, 0.3) == pytest.approx(1) and toxicity.chance(3, 3, 0.1) == pytest.approx(0.001)
    cells = [(2, 0, 50), (9, 0, 3), (1, 5, 900)]
    assert set(toxicity.telling(cells, 0.1)) == {(9, 0)}


def test_rule_model_is_plain_expectation_maximisation():
    """Voter by voter and document by document, without patterns, gives the same rates and verdicts."""
    rng = np.random.default_rng(5)
    good = rng.random(300) < 0.8
    votes = np.where(rng.random((300, 3)) < 0.2, 0, np.where(good[:, None], 1, -1) * np.where(rng.random((300, 3)) < 0.1, -1, 1))
    tally = defaultdict(int)
    for row in votes.tolist():
        tally[tuple(row)] += 1
    prior, rates = quality_rules.fit_label_model(sorted(tally.items()), rounds=20)
    post = np.array([0.02 if -1 in row else 0.98 for row in votes.tolist()])
    held = quality_rules.STRENGTH * 300 + 1
    for _ in range(20):
        p = (post.sum() + 1) / 302
        want = []
        for r in range(3):
            want.append({v: tuple((held * belief + w[votes[:, r] == v].sum()) / (w.sum() + held) for belief, w in zip(quality_rules.BELIEF[v], (post, 1 - post), strict=True)) for v in (-1, 0, 1)})
        z = np.log(p / (1 - p)) + sum(np.array([np.log(want[r][v][0] / want[r][v][1]) for v in votes[:, r].tolist()]) for r in range(3))
        post = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    assert prior == pytest.approx(p)
    assert all(rates[r][v] == pytest.approx(want[r][v]) for r in range(3) for v in (-1, 0, 1))


def plain_main_text(pages, min_run=8):
    """The array's definition without an array: every window of every page of a host is compared."""
    streams = []
    for page_id, url, html in pages:
        host = (url or "").split("://")[-1].split("/")[0].split("?")[0].split(":")[0].lower() if "://" in (url or "") else ""
        blocks = pagetext.page_blocks(html)
        streams.append((page_id, url, host, blocks, [w for _, t in blocks for w in t.split()]))
    holders = defaultdict(set)
    for _, _, host, _, tokens in streams:
        for i in range(len(tokens) - min_run + 1):
            holders[host, tuple(tokens[i : i + min_run])].add(tuple(tokens))
    out = []
    for page_id, url, host, blocks, tokens in streams:
        text = pagetext.marked_text(blocks)
        if text is None:
            starts = [i for i in range(len(tokens) - min_run + 1) if len(holders[host, tuple(tokens[i : i + min_run])]) > 1]
            covered = {p for i in starts for p in range(i, i + min_run)}
            left, at = [], 0
            for level, block in blocks:
                words = block.split()
                own = range(at, at + len(words))
                inside = {p for i in starts if i >= at and i + min_run <= at + len(words) for p in range(i, i + min_run)}
                stay = [] if all(p in covered for p in own) else [w for p, w in zip(own, words, strict=True) if p not in inside]
                if level >= 0 and stay:
                    left.append(" ".join(stay))
                at += len(words)
            text = "\n".join(left)
        out.append((page_id, url, text))
    return sorted(out, key=str)


@pytest.mark.parametrize("marked", [True, False])
def test_main_text_of_whole_tables(spark, sf_dir, marked):
    """As they are, and with the marks of articles taken away, so that the array decides."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    if not marked:
        host = F.concat(F.lit("http://h"), (F.col("page_id") % 3).cast("string"), F.lit(".org/"))
        pages = pages.withColumn("html", F.regexp_replace("html", "(?i)(</?)(article|main)", "$1div")).withColumn("url", host)
    out = sorted(map(tuple, pagetext.main_text(pages).collect()), key=str)
    assert out == plain_main_text([tuple(r) for r in pages.collect()])
    assert out == sorted(map(tuple, pagetext.main_text(pages, every_host=True).collect()), key=str)
    assert sum(bool(t) for _, _, t in out) > 0.5 * len(out)


def test_long_repeats_are_covered_as_chains(spark):
    """Repeats far longer than a key, tails that differ, a copy that stands on very many pages."""
    words = [f"w{k}" for k in range(200)]
    rows = [(k, "http://a.b/", f"<p>start {k} here</p><p>{' '.join(words[: 60 + k % 7])} end {k} of it</p>") for k in range(60)]
    out = sorted(map(tuple, pagetext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()), key=str)
    assert out == plain_main_text(rows)


@pytest.mark.parametrize(("page", "text"), [
    ('<form action="x"><div><h1>T</h1><p>' + "long body " * 20 + "</p></div></form>", None),
    ('<form><article><p>' + "long body " * 20 + "</p></article></form>", ("long body " * 20).strip()),
    ('<article><header><h1>Title</h1></header><p>body text</p></article>', "Title\nbody text"),
    ('<body><div class="layout has-sidebar"><article><p>body text</p></article><div class="sidebar">side</div></div></body>', "body text"),
    ('<div class="no-sidebar"><article>body text</article></div>', "body text"),
    ('<div id="page" class="with-banner"><main>body text</main></div>', "body text"),
    ('<div class="sidebar-layout"><nav>menu</nav><article>body text</article></div>', "body text"),
    ('<article><div class="article-header"><h1>Title</h1></div><p>body text</p></article>', "Title\nbody text"),
    ('<article><p>body text</p><p class="notice-board">the board met</p></article>', "body text\nthe board met"),
    ('<article><p>body text</p><div class="ad-slot">buy</div><section class="user-comments">mine</section></article>', "body text"),
    ('<main><p>the body of it</p></main><div class="related-posts"><article>other</article></div>', "the body of it"),
    ('<div class="site-header">head</div><article>body text</article><div id="siteFooter">foot</div>', "body text"),
    ('<header>site</header><article><p>body text</p></article>', "body text"),
    ('<article><p>the body of it</p></article><article class="comment"><p>great</p></article>', "the body of it"),
    ('<main><p>the body of it and more</p><article class="teaser"><p>other</p></article></main>', "the body of it and more"),
    ('<article class="post-with-sidebar"><p>body</p></article>', "body"),
])
def test_structure_votes(page, text):
    assert pagetext.marked_text(pagetext.page_blocks(page)) == text


def test_whole_page_form_keeps_its_text():
    assert [n for n, _ in pagetext.page_blocks("<form><p>" + "body " * 30 + "</p></form><p>end</p>")] == [0, 0]
    assert [n for n, _ in pagetext.page_blocks("<p>" + "body " * 30 + "</p><form><p>your name</p></form>")] == [0, -1]


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<!--", "<script ", "<", '<p x="', "<a b='>", "<![CDATA[", "</a", "<textarea>"])
def test_broken_markup_takes_linear_time(unit):
    import time

    began = time.process_time()
    pagetext.page_blocks(unit * 30_000)
    assert time.process_time() - began < 5


def test_shards_balance_all_measures_and_keep_groups(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(["word"] * int(n)) + f" {k}" for k, n in enumerate(np.clip(rng.lognormal(3, 1, 2500), 1, 3000))] + ["copy of one text"] * 90 + ["hot " * 50] * 1500
    docs = spark.createDataFrame([(k % 3000, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    out = sharding.assign_shards(docs, shards=8).withColumnRenamed("text_crc32", "c").collect()
    import zlib

    where, load = defaultdict(set), defaultdict(lambda: np.zeros(3))
    text_of = {zlib.crc32(t.encode()): t for t in texts}
    for r in out:
        where[r["c"]].add(r["shard"])
        load[r["shard"]] += [r["size"], len(text_of[r["c"]].split()), 1]
    assert len(out) == len(texts)
    assert {c for c, s in where.items() if len(s) > 1} == {zlib.crc32(("hot " * 50).encode())}
    total = np.array(list(load.values()))
    assert (total.max(axis=0) / total.mean(axis=0) < [1.03, 1.1, 1.1]).all()


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(None, "a"), (None, "b"), (1, "c"), (1, "c"), (1, "d"), (2, None)]
    docs = spark.createDataFrame([(d, t, "x", k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, shard string, n int")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["n"] for r in back) == list(range(6)) and {r["shard"] for r in back} <= {0, 1, 2}


def test_repeated_ids_do_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(k % 4, f"text {k} of words") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, quality int")
    seen = []
    real = embed_classifier.fit

    def spy(chunks, n, **options):
        seen.append((n, sum(map(len, chunks()))))
        return real(chunks, n, **options)

    embed_classifier.fit = spy
    try:
        embed_classifier.train(docs, labels, "quality", F.lit(False))
    finally:
        embed_classifier.fit = real
    assert seen == [(4, 4)]


def test_features_are_of_code_points():
    n = lambda text: sum(map(len, embed_classifier.features(text)))
    assert n("éééé") == n("abcd") and n("") == n(None) == 0
