import gzip
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import langnet, linespread, warc

from . import cases


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def net(labelled):
    return langnet.fit(labelled.filter(~langnet.held_out()))


def test_held_out_accuracy(labelled, net):
    told = langnet.predict(labelled, net, "text", ["doc_id", "lang"]).filter(langnet.held_out()).collect()
    assert len(told) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in told]) > 0.97


def test_held_out_rule(spark):
    ids = spark.range(-3, 50).select(F.col("id").alias("doc_id")).select("doc_id", langnet.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in ids)


def test_awkward_texts(spark, net):
    rows = cases.awkward()
    df = cases.table(spark, rows, [c for c in cases.CLASHES if c != "score"])
    got = langnet.predict(df, net, "text", ["doc_id", "text", "row"]).collect()
    assert len(got) == len(rows)
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert r["row"] == "x"
    assert langnet.predict(cases.empty(spark), net, "text", ["doc_id"]).count() == 0


def test_nothing_to_learn_from(spark):
    df = cases.table(spark, [(1, "text", None, "s", 1), (2, None, "en", "s", 1), (3, "12", "de", "s", 1)])
    assert langnet.fit(df) is None and langnet.fit(cases.empty(spark)) is None
    assert {r["lang_pred"] for r in langnet.predict(df, None, "text", ["doc_id"]).collect()} == {"und"}


def test_windows_cover_every_byte():
    texts = [b"", b"a" * 5, bytes(range(1, 251)) * 3, b"z" * langnet.WINDOW]
    win, row, weight = langnet.windows(texts)
    for i, t in enumerate(texts):
        assert b"".join(win[k, :weight[k]].tobytes() for k in np.flatnonzero(row == i)) == t


def test_gradients_lower_the_loss():
    rng = np.random.default_rng(0)
    win = np.concatenate([rng.integers(97, 105, (60, langnet.WINDOW)), rng.integers(105, 113, (20, langnet.WINDOW))]).astype(np.uint8)
    y = np.repeat([0, 1], [60, 20])
    net = langnet.train(win, y, ["a", "b"], epochs=5)
    assert (langnet.probabilities(net, win).argmax(axis=1) == y).all()


PAGES = [
    (1, "http://a.example/x", "<html><head><title>T &amp; U</title><script>var a='<p>';</script></head><body><p>One&nbsp;1<br>two<!-- no --></p><a href='/l'>go</a></body></html>"),
    (1, "http://a.example/x", "<p>again</p>"), (2, None, "<p>no address</p>"), (3, "  ", None), (None, "http://b.example/\r\nX: y", ""),
    (4, "http://c.example/" + "é" * 50, "<div>" + "long é " * 40_000 + "</div>"), (4, "http://d.example", "a < b and c > d"),
]


def test_derived_records(spark):
    pages = spark.createDataFrame(PAGES + PAGES[:1], "page_id bigint, url string, html string").withColumn("file", F.lit("x")).repartition(3)
    folder, manifest = warc.write_derivatives(pages)
    got = warc.read_records(spark, folder, manifest, with_text=True).collect()
    assert len(got) == 2 * (len(PAGES) + 1) and all(r["digest_ok"] for r in got)
    want = {}
    for key, url, page in PAGES + PAGES[:1]:
        for headers, block in warc.derive("" if key is None else str(key), url, page):
            h = dict(headers)
            want.setdefault(h["WARC-Record-ID"], []).append((h, block))
    for r in got:
        h, block = want[r["record_id"]][0]
        assert r["block"] == block.decode() and r["content_length"] == len(block)
        assert r["refers_to"] == h["WARC-Refers-To"] and r["target_uri"] == h["WARC-Target-URI"]
        assert r["source_digest"] == h["X-Source-Payload-Digest"]
    text = next(r for r in got if r["record_type"] == "conversion" and r["block"].startswith("One"))
    facts = next(r for r in got if r["concurrent_to"] == text["record_id"])
    assert facts["record_type"] == "metadata"
    assert text["block"] == "One\xa01\ntwo\ngo"
    assert facts["concurrent_to"] == text["record_id"] and facts["refers_to"] == text["refers_to"]
    assert "title: T & U\r\n" in facts["block"] and "outlink: /l\r\n" in facts["block"] and "source-header: Content-Type" in facts["block"]
    assert warc.digest((PAGES[0][2]).encode()) in facts["block"]


def test_no_pages(spark):
    folder, manifest = warc.write_derivatives(spark.createDataFrame([], "page_id bigint, url string, html string"))
    assert warc.read_records(spark, folder, manifest).count() == 0


def test_members_are_independent():
    parts = [b"a" * 10, b"", bytes(range(256)) * 900]
    raw = b"".join(gzip.compress(p) for p in parts)
    assert list(warc.members(raw, step=7)) == parts
    with pytest.raises(ValueError):
        list(warc.members(raw[:-3]))


def lines_brute(rows, sites):
    strip = " \t\n\x0b\x0c\r"
    seen = {}
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(strip) and site is not None:
                seen.setdefault(line.strip(strip), set()).add(site)
    gone = {k for k, v in seen.items() if len(v) >= sites}
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if x.strip(strip) not in gone]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("sites", [1, 3, 40])
def test_spread_lines(spark, sites):
    rows = [(r[0], r[1], r[3]) for r in cases.awkward()]
    for i in range(300):
        rows.append((100 + i, f"own {i}\n footer \nshared {i % 60}\n\nsix {i % 2}\t\n", f"s{i % 97}"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("h1", F.lit(1)).withColumn("cut", F.lit(1)).repartition(4)
    got = linespread.drop_spread_lines(df, sites=sites).collect()
    assert sorted(((r["id"], r["text"], r["n_lines"], r["n_removed"]) for r in got), key=str) == sorted(lines_brute(rows, sites), key=str)


def test_no_lines(spark):
    assert linespread.drop_spread_lines(cases.empty(spark)).count() == 0


def test_spread_lines_of_a_text_with_many_copies(spark):
    """A third of all rows is one text: it is dealt over many keys, and every copy is cleaned alike."""
    hot = "menu\n own \n\nmenu\nlast"
    rows = [(i, hot, f"s{i % 7}") for i in range(400)] + [(1000 + i, f"menu\nalone {i}\nmenu", None) for i in range(800)]
    got = linespread.drop_spread_lines(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), sites=7).collect()
    assert len(got) == 1200
    # "menu", "own" and "last" stand on seven sites; the blank line stays
    assert {(r.text, r.n_lines, r.n_removed) for r in got if r.id < 1000} == {("", 5, 4)}
    assert {(r.text, r.n_lines, r.n_removed) for r in got if r.id >= 1000} == {(f"alone {i}", 3, 2) for i in range(800)}


def test_spread_lines_of_a_long_text(spark):
    lines = [f"l{i}" if i % 3 else "all" for i in range(30_000)]
    rows = [(i, "\n".join(lines) if i == 0 else "all", f"s{i}") for i in range(6)]
    got = {r.id: r for r in linespread.drop_spread_lines(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), sites=6).collect()}
    assert got[0].text == "\n".join(x for x in lines if x != "all") and got[0].n_removed == 10_000
    assert got[3].text == "" and got[3].n_lines == 1
