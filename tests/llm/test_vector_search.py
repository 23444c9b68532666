import math
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import bestposition, sortedlists, vectors, whiten

from . import cases

VECTORS = "vec_id bigint, embedding array<float>, label int"


def vector_rows(n=120, d=6, seed=1, spread=0.4):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in rng.normal(0, spread, d).astype(np.float32)], 1) for i in range(n)]
    copies = [(1000 + i, rows[3][1], 2) for i in range(40)]  # one vector that stands in a quarter of the rows
    bad = [(2000, None, 0), (2050, [0.1, None, 0.2, 0.0, 0.0, 0.0], 0), (2100, [math.inf] + [0.0] * 5, 0), (2150, [math.nan] + [0.0] * 5, 0)]
    odd = [(None, rows[5][1], None), (50, rows[7][1], None), (50, rows[8][1], None), (3, rows[3][1], 1), (3000, [0.25, -0.5], 1),
           (3050, [], 1), (-100, [-0.0] * d, 1)]
    return rows + copies + bad + odd


def vector_table(spark, rows, partitions=4):
    df = spark.createDataFrame(rows, VECTORS).repartition(partitions)
    for name in ("id", "x", "number", "piece", "task", "score", "rank", "n", "a.b", "my col"):
        df = df.withColumn(name, F.lit("x"))
    return df


def integers(rows):
    return [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, _ in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def products(rows, every, k):
    usable = integers(rows)
    out = []
    for q, x in usable:
        if q is not None and q % every == 0:
            found = [(sum(a * b for a, b in zip(x, y)), i) for i, y in usable if len(y) == len(x) and i != q]
            found.sort(key=lambda f: (-f[0], f[1] is None, f[1] or 0))
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,entries", [(4096, 1 << 19), (16, 20)])
def test_products_equal_brute_force(spark, monkeypatch, block, entries):
    rows = vector_rows()
    table = vectors.integer_vectors(vector_table(spark, rows), "vec_id", "embedding")
    got = sortedlists.search(sortedlists.build_lists(table, block), table.filter("id % 50 = 0"), 5, entries)
    assert sorted(map(tuple, got.collect()), key=str) == products(rows, 50, 5)
    assert got.columns == ["query_id", "rank", "id", "score"]


def test_products_without_rows_or_queries(spark):
    assert sortedlists.top_products(vector_table(spark, [])).count() == 0
    assert sortedlists.top_products(vector_table(spark, [(1, [0.5], 1), (2, [0.5], 1)])).count() == 0
    assert sortedlists.top_products(vector_table(spark, [(50, [0.5], 1), (2, [0.5], 1)])).collect()[0]["score"] == 128 * 128


@pytest.mark.parametrize("largest", [3, 1 << 20, 1 << 40])
def test_lists_are_left_early_and_nothing_is_lost(largest):
    """Every block of random vectors, also with ties, zero queries and products beyond 2 ** 63."""
    rng = np.random.default_rng(largest)
    read = 0
    for trial in range(40):
        n, d = int(rng.integers(1, 300)), int(rng.integers(0, 9))
        x = rng.integers(-largest, largest, (n, d))
        q = x[0].copy() if trial % 3 else np.zeros(d, np.int64)
        blocks = [x[s:s + 64] for s in range(0, n, 64)]
        asked = sortedlists.Queries([9], [0], q[None, :], 4)
        best = asked.best[0]
        for b, part in enumerate(blocks):
            ids = list(range(64 * b, 64 * b + len(part)))
            read += sortedlists.Block(ids, part, sortedlists.Block.sort(part)).search(asked)
        want = sorted(((sum(int(a) * int(c) for a, c in zip(q, y)), i) for i, y in enumerate(x) if i), key=lambda p: (-p[0], p[1]))[:4]
        assert list(zip(best.scores, best.ids)) == want
    assert read


def test_search_reads_part_of_the_lists():
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(0, 0.125, (4096, 32))).astype(np.int64)
    asked = sortedlists.Queries(list(range(600)), list(range(600)), x[:600], 5)
    first = sortedlists.Block(list(range(2048)), x[:2048], sortedlists.Block.sort(x[:2048]))
    first.search(asked)
    second = sortedlists.Block(list(range(2048, 4096)), x[2048:], sortedlists.Block.sort(x[2048:]))
    assert 0 < second.search(asked) < 0.7 * 600 * 32 * 2048
    scores = x[:600] @ x.T
    scores[np.arange(600), np.arange(600)] = -(1 << 60)
    assert [b.scores for b in asked.best] == np.sort(scores, axis=1)[:, :-6:-1].tolist()


def test_whitening_equals_fractions(spark):
    rows = vector_rows(60, 3)
    rows = [r for r in rows if r[1] is None or len(r[1]) != 2] + [(4000, [0.5, 0.5], 1)]
    rows = [(i, v[:3] if v and len(v) > 3 else v, x) for i, v, x in rows]
    got = whiten.whiten(vector_table(spark, rows), components=4).collect()
    usable = [(i, x) for i, x in integers(rows) if len(x) == 3]
    assert len(got) == 3 * len(usable)
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    cov = [[float(sum((Fraction(x[i]) - Fraction(sums[i], n)) * (Fraction(x[j]) - Fraction(sums[j], n)) for x in fit) / n)
            for j in range(3)] for i in range(3)]
    values, directions = np.linalg.eigh(np.array(cov))
    by = {}
    for r in got:
        by.setdefault((r["id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
        assert r["n"] == n and 0 <= r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[::-1][r["component"] - 1] / values.sum(), rel=1e-12)
    signs = {}
    for i, x in usable:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for c in (1, 2, 3):
            want = (np.array(x) - np.array(sums) / n) @ directions[:, -c] / math.sqrt(values[-c])
            same = by[(i, deviation)][c]
            sign = signs.setdefault(c, 1 if same[0]["whitened"] * want >= 0 else -1)
            assert any(r["whitened"] == pytest.approx(sign * want, abs=1e-9) for r in same)


def test_whitening_without_variance_or_rows(spark):
    assert whiten.whiten(vector_table(spark, [])).count() == 0
    assert whiten.whiten(vector_table(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    same = whiten.whiten(vector_table(spark, [(1, [0.5, 1.0], 1), (2, [0.5, 1.0], 1)])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(1, 0, None, None, None)] * 4
    line = whiten.whiten(vector_table(spark, [(1, [0.0, 1.0], 1), (2, [0.5, 1.0], 1), (None, [0.5, 1.0], 1)])).collect()
    assert sorted(abs(r["whitened"]) for r in line if r["component"] == 1) == pytest.approx([1, 1, 1])
    assert all(r["whitened"] is None for r in line if r["component"] == 2)
    assert {r["explained"] for r in line} == {1.0, 0.0}


@pytest.mark.parametrize("largest", [100, 1 << 30, 1 << 45, 1 << 61])
def test_sums_are_exact(largest):
    rng = np.random.default_rng(largest % 97)
    x = rng.integers(-largest, largest, (50, 4))
    plain = x.astype(object)
    assert whiten.exact_sum(x) == plain.sum(axis=0).tolist()
    for axis in (0, 1):
        assert whiten.exact_squares(x, axis) == (plain * plain).sum(axis=axis).tolist()
    sums = whiten.exact_sum(x)
    y = whiten.centred(x, 50, sums)
    want = 50 * plain - np.array(sums, object)
    assert (y.astype(object) == want).all()
    pairs = [(want[:, i] + (want[:, j] if i != j else 0)) for i in range(4) for j in range(i, 4)]
    assert whiten.pair_squares(y) == [int((p * p).sum()) for p in pairs]


def terms(text):
    return cases.alnum(text)


def ranked(rows, items, k):
    """The formula term by term, without lists."""
    docs = [(i, terms(t)) for i, t, *_ in rows]
    docs = [(i, w) for i, w in docs if w]
    n_docs, total = len(docs), sum(len(w) for _, w in docs)
    df = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, w in docs:
            m = 100 - 75 + (75 * len(w) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 8 * m))
                        for t in terms(text) if t in df)
            if score > 0:
                found.append((score, i))
        found.sort(key=lambda f: (-f[0], f[1] is None, f[1] or 0))
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k,piece,block", [(10, 1 << 15, 4096), (3, 4, 8)])
def test_search_equals_the_formula(spark, monkeypatch, k, piece, block):
    monkeypatch.setattr(bestposition, "BLOCK_DOCS", block)
    monkeypatch.setattr(bestposition, "FIRST_READ", 2)
    monkeypatch.setattr(bestposition, "LOOK_AHEAD", 3)
    rng = np.random.default_rng(5)
    words = ["the", "of", "É", "日本", "x1", *[f"w{i}" for i in range(40)]]
    weight = 1 / np.arange(1, len(words) + 1)
    rows = cases.awkward() + [(100 + i, " ".join(rng.choice(words, rng.integers(1, 40), p=weight / weight.sum())), "en", "s", 1) for i in range(150)]
    rows += [(500 + i, "the same text the", "en", "s", 1) for i in range(60)]  # a third of all rows
    items = [(1, "The same, text!"), (2, None), (3, " -- "), (4, "w3 w3 w9 É"), (5, "the of the of THE w39"), (None, "quick brown"),
             (4, "日本 x1"), (6, "nowhere"), (7, " ".join(words))]
    table = spark.createDataFrame(items, "item_id int, text string").withColumns({"id": F.lit(1), "terms": F.lit("x"), "piece": F.lit(0)})
    got = bestposition.search(cases.table(spark, rows), table, k, piece_terms=piece)
    assert sorted(map(tuple, got.collect()), key=str) == ranked(rows, items, k)


def test_search_without_documents_or_items(spark):
    none = spark.createDataFrame([], "item_id int, text string")
    some = spark.createDataFrame([(1, "quick fox")], "item_id int, text string")
    assert bestposition.search(cases.table(spark, cases.awkward()), none).count() == 0
    assert bestposition.search(cases.empty(spark), some).count() == 0
    assert bestposition.search(cases.table(spark, [(1, None, "en", "a", 1)]), some).count() == 0


def test_blocks_are_left_when_the_bound_is_below_the_kth():
    rng = np.random.default_rng(2)
    impact = rng.integers(1, 1000, (6, 2000))
    impact[:, :5] = 5000 - np.arange(5)  # documents that lead every list
    doc, term = np.tile(np.arange(2000), 6), np.repeat(np.arange(6), 2000)
    block = bestposition.Block(list(range(2000)), doc, term, impact.ravel(), 6)
    best = vectors.Best(5)
    met = block.search(np.arange(6), np.ones(6, np.int64), best)
    assert best.ids == [0, 1, 2, 3, 4] and met < 200
    assert best.scores == sorted(impact.sum(axis=0).tolist(), reverse=True)[:5]


def test_terms_are_the_pattern(spark):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    text = "".join(map(chr, range(256))) + " Ünï-ΑΣ Σ x_y É1"
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    got = bestposition.query_terms(spark.createDataFrame([(1, text)], "item_id int, text string"), "item_id", "text").first()
    want = pattern.findall(low)
    assert dict(zip([bytes(t).decode() for t in got["terms"]], got["times"])) == {w: want.count(w) for w in want}
