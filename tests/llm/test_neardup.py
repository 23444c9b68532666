import random

import numpy as np
import pytest

from rasterloom.llm import neardup
from rasterloom.llm.components import connected_components

from . import cases


def shingle_set(text, k):
    w = cases.words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k, percent):
    """Component per row index (smallest index-independent id), by comparing all pairs."""
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [(doc_id, len(sets[i]), least.get(root(i))) for i, (doc_id, _) in enumerate(rows)]


def copies(seed=5):
    """Chains and stars of near copies around the threshold, exact copies, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, next_id = [], 0
    for _ in range(6):
        base = [word() for _ in range(120)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.choice((0, 1, 2, 4, 8, 20))):
                w[rng.randrange(len(w))] = word()
            rows.append((next_id, " ".join(w)))
            next_id += 1
            if rng.random() < 0.2:
                base = w
    return rows


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
@pytest.mark.parametrize("block", [neardup.BLOCK_SHINGLES, 300])
def test_components_equal_all_pairs(spark, k, percent, block):
    rows = copies()
    df = cases.table(spark, [(i, t, "en", "s", 1) for i, t in rows])
    got = neardup.near_duplicates(df, shingle=k, percent=percent, block=block)
    assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == sorted(brute(rows, k, percent))


def test_awkward_rows(spark):
    rows = cases.awkward()
    got = neardup.near_duplicates(cases.table(spark, rows), shingle=3, percent=85).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = brute([(r[0], r[1]) for r in rows], 3, 85)
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    assert neardup.near_duplicates(cases.empty(spark)).count() == 0
    assert neardup.keep_one(cases.empty(spark)).count() == 0


def test_keep_one(spark):
    df = cases.table(spark, cases.awkward())
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    # the three copies leave id -2; the texts without words all stay
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    want = [r[:2] for r in cases.awkward() if r[0] != 7 or r[1].startswith("another")]
    assert got == sorted(want, key=str)


def test_equal_rows_leave_one(spark):
    df = cases.table(spark, [(1, "one two three four five six", "en", "s", 1)] * 5)
    assert neardup.keep_one(df).count() == 1


def test_null_ids_are_grouped_too(spark):
    df = cases.table(spark, [(None, "one two three four five six", "en", "s", 1)] * 3 + [(None, "seven eight nine ten", "en", "s", 1)])
    assert neardup.keep_one(df).count() == 2


def test_dense_and_sparse_confirmation_agree():
    h = np.sort(np.random.default_rng(1).choice(400, (30, 90)).astype(np.uint64) + np.uint64(1), axis=1)
    rows = [np.unique(r) for r in h]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    every = np.arange(30)
    both = neardup._shared(np.concatenate(rows), offsets, every, every)
    assert all(both[i, j] == len(set(rows[i]) & set(rows[j])) for i in range(30) for j in range(30))


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_components_of_a_hub_and_a_chain(spark):
    """A node with most of the edges is hot in every round; a chain and a hub of its own stay apart."""
    edges = [(7, i) for i in range(100, 1600)] + [(i, i + 1) for i in range(2000, 2040)] + [(3000, i) for i in range(3001, 3301)] + [(1599, 3300)]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    chain = {i: 2000 for i in range(2000, 2041)}
    assert got == {i: 7 for i in [7, *range(100, 1600), *range(3000, 3301)]} | chain
