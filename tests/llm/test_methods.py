"""Held-out accuracy of the trained operators, page structure, archives, and parts of the methods by themselves."""

from __future__ import annotations

import numpy as np
import pytest
from strandloom.llm import linededup, packing, pagetext, quality_rules, sharding, toxicity, warc
from strandloom.llm.common import table
from strandloom.llm.graph import connected_components
from strandloom.llm.queries import QUERIES



def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize(("name", "label", "folder"), [("op5_quality_classifier", "quality", "sf0.01"), ("op7_toxicity", "toxic", "sf0.01"), ("op7_toxicity", "toxic", "sf0.1")])
def test_held_out_accuracy(spark, name, label, folder):
    folder = f"/root/testdata/{folder}"
    labels = table(spark, folder, "labels").select("doc_id", label).filter(f"{label} is not null")
    rows = QUERIES[name](spark, folder).filter("held_out").join(labels, "doc_id").select("score", label, "predicted").collect()
    assert auc([(r[0], r[1]) for r in rows]) >= 0.9
    assert np.mean([r[1] == r[2] for r in rows]) >= 0.85
    assert np.mean([r[2] for r in rows if r[1]]) >= 0.9


def test_held_out_labels_are_not_learned(spark, sf_dir):
    from pyspark.sql import functions as F

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = lambda x: sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(docs, x).collect())
    assert scores(labels) == scores(turned)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><header>Site</header>
<div class="cookie-notice">We use cookies</div><article><h1>A &lt;title&gt;</h1><p>First   line<br>goes <b>on</b>.</p><aside>advert</aside><ul><li>one<li>two</ul>
<form>name <input></form><section id="comments"><p>great!</p></section><p>Last&nbsp;one &#8364;</p></article><footer>(c)</footer><script>var a = "<p>no</p>"</script></body></html>"""


def test_page_structure():
    assert pagetext.marked_text(pagetext.page_blocks(PAGE)) == "A <title>\nFirst line goes on .".replace("on .", "on.") + "\none\ntwo\nLast one €"


def test_repeated_runs_of_a_host(spark):
    """Pages without marks: what long repeats cover goes, only within the host; unique runs stay in order."""
    menu = "home news sport weather travel culture money contact us"
    rows = [(k, f"http://h{k % 2}.org/{k}", f"<p>{menu}</p><p>unique text of page number {k} stands right here</p><p>{menu}</p>") for k in range(6)] + [(9, "http://other.org", f"<p>{menu}</p>")]
    out = dict(map(tuple, pagetext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text").collect()))
    assert out == {k: f"unique text of page number {k} stands right here" for k in range(6)} | {9: menu}


def test_arc_versions_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://a.b/{k} x", f"<p>\r\n\r\nWARC/1.1 {k % 3} é</p>\n") for k in range(30)], "page_id long, url string, html string").repartition(4)
    warc.write_arc(pages, f"{tmp_path}/arc", "20240305060708")
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    rows = warc.read_warc(spark, f"{tmp_path}/warc", with_payload=True).collect()
    assert len(rows) == 30 and all(r["date"] == "2024-03-05T06:07:08Z" for r in rows)
    assert {r["page_id"]: bytes(r["payload"]) for r in rows if r["record_type"] == "response"} == {k: f"<p>\r\n\r\nWARC/1.1 {k % 3} é</p>\n".encode() for k in range(3)}
    assert {r["page_id"]: r["refers_to"] for r in rows if r["record_type"] == "revisit"} == {k: k % 3 for k in range(3, 30)}
    ids = {r["page_id"]: r["record_id"] for r in rows}
    assert all(r["refers_to_id"] == ids[r["refers_to"]] for r in rows if r["record_type"] == "revisit") and len(set(ids.values())) == 30


DNS = b"20240102030405\na.example. 300 IN A 192.0.2.1\n"
IMAGE = bytes(range(256)) * 3
LATIN = b"HTTP/1.0 200 OK\nContent-Type: text/html; charset=iso-8859-1\n\n<p>caf\xe9 \r\n\r\n fin</p>"
BINARY = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\nContent-Length: 5\r\n\r\n" + IMAGE


def legacy_archive(version):
    """An ARC file written out by hand, one field list a version."""
    middle = b"" if version == 1 else b" 200 CHECKSUM - 1234 name.arc.gz"
    about = b"1 0 InternetArchive\nURL IP-address Archive-date Content-type Archive-length\n" if version == 1 else b"2 0 InternetArchive\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    out = [b"filedesc://old.arc 0.0.0.0 19990102030405 text/plain" + middle + b" %d\n" % len(about) + about]
    for url, kind, content in ((b"dns:a.example", b"text/dns", DNS), (b"http://a.example/caf\xc3\xa9 x", b"text/html", LATIN), (b"http://a.example/i.png", b"image/png", BINARY), (b"http://b.example/i.png", b"image/png", BINARY), (b"ftp://a.example/f", b"no-type", b"")):
        out.append(url + b" 192.0.2.7 1999010203" + b" " + kind + middle + b" %d\n" % len(content) + content)
    return out


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("zipped", [False, True])
def test_foreign_archives_are_converted(spark, tmp_path, version, zipped):
    import gzip

    records = legacy_archive(version)
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "old.arc").write_bytes(b"".join(gzip.compress(r + b"\n") for r in records) if zipped else b"\n".join(records) + b"\n")
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", records_per_file=3)
    rows = {r["url"]: r for r in warc.read_warc(spark, f"{tmp_path}/warc", with_payload=True).collect()}
    assert {u: (r["record_type"], bytes(r["payload"])) for u, r in rows.items()} == {
        "dns:a.example": ("resource", DNS), "http://a.example/café x": ("response", b"<p>caf\xe9 \r\n\r\n fin</p>"), "http://a.example/i.png": ("response", IMAGE), "http://b.example/i.png": ("revisit", b""), "ftp://a.example/f": ("resource", b""),
    }
    assert all(r["date"] == "1999-01-02T03:00:00Z" and r["page_id"] is None for r in rows.values())
    assert rows["http://b.example/i.png"]["refers_to_id"] == rows["http://a.example/i.png"]["record_id"]
    assert rows["http://b.example/i.png"]["payload_bytes"] == len(IMAGE)
    files = sorted((tmp_path / "warc").glob("part-*"))
    assert len(files) == 3  # 5 records and the warcinfo of each file, at most 3 a file
    for f in files:
        kinds = [h["warc-type"] for h, _ in warc.parse_warc(f.read_bytes())]
        assert kinds[0] == "warcinfo" and "warcinfo" not in kinds[1:] and f.read_bytes().count(b"\x1f\x8b\x08") >= len(kinds)


def test_damaged_records_are_errors(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a.b/1", "<p>one</p>")], "page_id long, url string, html string").coalesce(1)
    warc.write_arc(pages, f"{tmp_path}/arc")
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    whole = gzip.decompress(next((tmp_path / "warc").glob("part-*")).read_bytes())
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x").write_bytes(whole.replace(b"<p>one", b"<p>two"))
    with pytest.raises(Exception, match="does not agree"):
        warc.read_warc(spark, f"{tmp_path}/bad").collect()
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.parse_warc(whole[:-20]))


def test_arc_header_line_must_fit_its_version():
    good = warc.arc_head("1", "20000101000000") + warc.arc_line("1", "http://a", "text/html", 2, "2000") + "\nhi"
    assert [r["content"] for r in warc.read_arc(good.encode())] == [b"hi"] and warc.warc_date("2000") == "2000-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        list(warc.read_arc((warc.arc_head("2", "20000101000000") + warc.arc_line("1", "http://a", "text/html", 2, "2000") + "\nhi").encode()))


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1100)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect())) == want


def test_best_fit_fills_sequences(spark):
    items = spark.createDataFrame([(k, 1024) for k in range(500)] + [(500 + k, 700) for k in range(50)] + [(600 + k, 3) for k in range(2000)], "item_id long, length long")
    out = packing.best_fit(items).join(items, "item_id").groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r[1] <= 2048 for r in out) and len(out) <= 1.03 * (500 * 1024 + 50 * 700 + 6000) / 2048 + 2


def test_filters_merge_exactly(spark):
    docs = spark.createDataFrame([("line number %d of some documents" % (k % 40),) for k in range(60)], "text string").repartition(7)
    packed, bits = linededup.repeated_filter(docs)
    held = linededup.may_hold(packed, linededup._hashes([b"line number %d of some documents" % k for k in range(40)]), bits)
    assert held.tolist() == [k < 20 for k in range(40)]


def test_rules_find_bad_patterns():
    good, bad = (1, 1, 1), (-1, -1, 0)
    prior, rates = quality_rules.fit_label_model([(good, 900), (bad, 80), ((0, -1, -1), 20)])
    assert prior > 0.85 and all(r[-1][1] > r[-1][0] for r in rates)


def test_vectors_are_balanced():
    units = np.random.default_rng(0).dirichlet(np.full(2000, 0.5), 3).T
    where = sharding.place(units, 16)
    load = np.stack([np.bincount(where, units[:, m], minlength=16) for m in range(3)])
    assert (abs(load * 16 - 1) < 0.05).all()
