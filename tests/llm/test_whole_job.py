"""Inputs on which an operator once did less than its whole job."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from strandloom.llm import decontaminate, packing, pagetext, simhash
from test_contracts import best_fit_count


def spread(kind: str, n: int) -> list[int]:
    rng = np.random.default_rng(7)
    if kind == "33-128":
        return rng.integers(33, 129, n).tolist()
    if kind == "520-680 and one of 1000":
        return [1000, *rng.integers(520, 681, n - 1).tolist()]
    if kind == "lognormal":
        return np.clip(rng.lognormal(np.log(60), 1, n).astype(int), 1, 2048).tolist()
    return [2048, 1, 1, 1025, 1023, 1024, 1024, *[683] * (n - 7)]


@pytest.mark.parametrize("kind", ["33-128", "520-680 and one of 1000", "lognormal", "edges"])
def test_packing_opens_no_more_sequences_than_best_fit(spark, kind):
    lengths = spread(kind, 3000)
    items = spark.createDataFrame(list(enumerate(lengths)), "item_id long, length long").repartition(5)
    out = [tuple(r) for r in packing.best_fit(items).collect()]
    assert sorted(i for i, _, _ in out) == list(range(len(lengths)))
    sequences = defaultdict(list)
    for i, s, offset in out:
        sequences[s].append((offset, lengths[i]))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(sequences) <= 1.002 * best_fit_count(lengths) + 1


def test_levels_match_successors():
    """The stack of slots gives each piece the smallest free slot that holds it, longest pieces first."""
    slots, pieces = {9: 2, 5: 1, 4: 3}, {7: 1, 5: 3, 4: 1, 2: 4}
    rows = packing._levels([(k, k, 0, [n]) for k, n in slots.items()], {k: [n] for k, n in pieces.items()})
    place = {}
    met = []
    for key, is_piece, _, _, _, base in rows:
        for rank in range(1, (pieces if is_piece else slots)[key] + 1):
            if is_piece:
                met.append((key, place.pop(base + 1 - rank, None)))
            else:
                place[base + rank] = key
    free, want = sorted(k for k, n in slots.items() for _ in range(n)), []
    for k in sorted((k for k, n in pieces.items() for _ in range(n)), reverse=True):
        s = next((g for g in free if g >= k), None)
        want.append((k, s))
        if s:
            free.remove(s)
    assert met == want


def test_hot_length_is_ranked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_SALT", 50)
    items = spark.createDataFrame([(k, 300 if k % 3 else 1 + k % 900) for k in range(2000)], "item_id long, length long").repartition(4)
    out = packing.best_fit(items).join(items, "item_id").groupBy("sequence_id").agg({"length": "sum", "item_id": "count"}).collect()
    assert sum(r["count(item_id)"] for r in out) == 2000 and all(r["sum(length)"] <= 2048 for r in out)
    assert len(out) <= 1.005 * best_fit_count([300 if k % 3 else 1 + k % 900 for k in range(2000)]) + 1


def test_long_white_space_is_encoded():
    from tokenizers import Tokenizer

    vocabulary = packing.default_vocabulary()
    whole = Tokenizer.from_file(vocabulary[0])
    for text in (" " * 1_000_000 + "x", "a" + "\n" * 5000 + "b", " " * 999 + "y"):
        assert packing._encoder(*vocabulary)(text) == whole.encode(text, add_special_tokens=False).ids


COPY = "one text that stands in many rows of the table as it was crawled again and again"
OTHER = "something else entirely was written under an id that another row of this table has too"
THIRD = "rows without any id may hold texts that nobody else in the whole table has ever held"
FOURTH = "yet another passage about rivers and bridges and boats that only null ids carry here"


def test_one_row_of_each_component_stays(spark):
    rows = [(5, COPY), (5, COPY), (7, COPY), (None, COPY), (5, OTHER), (3, OTHER), (None, THIRD), (None, THIRD), (None, FOURTH), (9, None), (8, "")]
    docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(4)
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert kept == Counter([(5, COPY), (3, OTHER), (None, THIRD), (None, FOURTH), (8, "")])


@pytest.mark.parametrize("max_windows", [2, 200_000])
def test_rows_are_judged_by_their_own_text(spark, max_windows):
    """A contaminated row takes neither rows without id nor rows of its id with it, also where the benchmark is cut in blocks."""
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(None, f"before {leak}"), (None, COPY), (None, None), (1, f"{leak} after"), (1, OTHER), (1, OTHER), (2, THIRD), (3, leak.upper())]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, row string").repartition(3)
    benchmark = spark.createDataFrame([("b1", leak), ("b2", "words of other items " * 5)], "item_id string, text string")
    out = decontaminate.clean_documents(docs, benchmark, max_windows=max_windows)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(None, COPY), (None, None), (1, OTHER), (1, OTHER), (2, THIRD)])


BODY = "the body of the article has many more words than its title"


@pytest.mark.parametrize(("page", "text"), [
    (f'<main><h1 class="post-title">T</h1><p>{BODY}</p></main>', f"T\n{BODY}"),
    (f'<main><h1 class="post">T</h1><p>{BODY}</p></main>', f"T\n{BODY}"),
    (f'<main><div class="entry"><h1>T</h1></div><p>{BODY}</p></main>', f"T\n{BODY}"),
    (f'<div class="entry-meta">today</div><div class="entry-content"><p>{BODY}</p></div>', BODY),
    (f'<main><h2>more</h2><article class="post"><p>{BODY}</p></article></main>', BODY),
    (f'<p class="text-center">short</p><p>{BODY}</p>', None),
    (f'<p>{BODY} <span class="body-small">small</span></p><p>{BODY}</p>', None),
    (f'<div class="content">short</div><p>{BODY}</p><p>{BODY}</p>', None),
])
def test_marks_of_decoration_do_not_decide(page, text):
    assert pagetext.marked_text(pagetext.page_blocks(page)) == text


def test_page_with_decoration_stays_whole(spark):
    pages = spark.createDataFrame([(1, "http://a.b/1", f'<p class="text-center">short</p><p>{BODY}</p>')], "page_id long, url string, html string")
    assert pagetext.main_text(pages).first()["text"] == f"short\n{BODY}"


def test_copies_of_an_unmarked_page_keep_their_text(spark):
    menu = "home news sport weather travel culture money contact us"
    body = "a unique passage that only this page and its copies hold from end to end"
    page = f"<p>{menu}</p><p>{body}</p>"
    other = f"<p>{menu}</p><p>what another page of this host has to say of other matters altogether</p>"
    rows = [(1, "http://a.b/1", page), (2, "http://a.b/1?copy", page), (2, "http://a.b/1?copy", page), (3, "http://a.b/3", other), (4, "http://c.d/1", page), (5, "http://c.d/2", page)]
    out = pagetext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).select("page_id", "text").collect()
    copies = f"{menu}\n{body}"  # nothing else of that host tells its menu from its text
    assert Counter(map(tuple, out)) == Counter([(1, body), (2, body), (2, body), (3, other[len(menu) + 10 : -4]), (4, copies), (5, copies)])


def test_repeats_inside_a_block_are_cut_out_of_it(spark):
    note = "this site uses many small files to remember what you like"
    rows = [(k, f"http://a.b/{k}", f"<p>page {k} begins {note} and goes on with number {k}</p>") for k in range(3)]
    out = dict(map(tuple, pagetext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text").collect()))
    assert out == {k: f"page {k} {k}" for k in range(3)}
