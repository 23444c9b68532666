import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, imatch, licenses, wordpiece

from . import cases


def windows_of(items, size):
    out = {}
    for item, text in items:
        w = cases.alnum(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            out.setdefault(tuple(w[i:i + n]), set()).add(str(item) if item is not None else "")
    return out


def scan_brute(text, windows):
    w = cases.alnum(text)
    hit, items = [0] * len(w), set()
    for n in {len(k) for k in windows}:
        for i in range(len(w) - n + 1):
            found = windows.get(tuple(w[i:i + n]))
            if found:
                items |= found
                hit[i:i + n] = [1] * n
    return len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "two words"), (3, None), (4, "!!!"),
         (5, "beta beta beta beta beta beta beta beta beta beta beta"), (5, "again five"), (None, "no item id"), (6, "É"),
         (7, "gamma delta epsilon zeta eta theta iota kappa lambda mu nu")]


@pytest.mark.parametrize("table_words", [decontaminate.TABLE_WORDS, 15])
def test_decontamination_equals_sliding_windows(spark, table_words):
    texts = ["x alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu y", "Alpha-BETA gamma", "two words two words",
             "beta " * 25, "a no item id b é", "alpha beta gamma delta epsilon zeta eta theta iota", "again FIVE"]
    rows = cases.awkward() + [(100 + i, t, "en", "s", 1) for i, t in enumerate(texts)]
    items = spark.createDataFrame(ITEMS, "item_id int, text string").withColumn("item", F.lit(1))
    got = decontaminate.scan(cases.table(spark, rows), items, "text", ["doc_id"], table_words=table_words).collect()
    want = [(r[0], *scan_brute(r[1], windows_of(ITEMS, 10))) for r in rows]
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got), key=str) == sorted(want, key=str)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got)


def test_decontamination_without_items_or_rows(spark):
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.scan(cases.table(spark, cases.awkward()), none, "text", ["doc_id"]).filter("n_hit > 0").count() == 0
    assert decontaminate.scan(cases.empty(spark), none, "text", ["doc_id"]).count() == 0


def test_license_places_and_spans(spark):
    mit = licenses.TEMPLATES["mit"]
    texts = ["MIT License mit-license (Apache) License", "general public license of the GNU General Public License",
             "intro " + mit + " outro", "x " + " ".join(mit.split()[:60]) + " inserted words here " + " ".join(mit.split()[60:]),
             "this software is distributed under the terms of the moon", "public license general"]
    rows = cases.awkward() + [(100 + i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = licenses.scan(cases.table(spark, rows), "text", ["doc_id", "text"]).collect()
    for r in got:
        w = cases.alnum(r["text"])
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        base = {label for _, label in places}
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)))
        assert base <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in got}
    assert by[102]["labels"] == "mit" and by[102]["score"] == 1.0
    assert [(s["start"], s["end"]) for s in by[102]["spans"]] == [(1, 1 + len(cases.alnum(mit)))]
    assert by[103]["labels"] == "mit" and by[103]["score"] > 0.95
    assert by[104]["labels"] == "" and by[105]["n_base"] == 0
    assert licenses.scan(cases.empty(spark), "text", ["doc_id"]).count() == 0


def test_matching_statistics_equal_brute_force():
    auto = licenses.Automaton({"x": "a b a b c a b a", "y": "b a b d a b"}, {"a b": "ab", "b a b": "bab"})
    sequences = [t.split() for t in ("a b a b c a b a", "b a b d a b")]
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    doc = "a b a b d a b a b c a b b a b a b a".split()
    found, longest = [], []
    codes = [auto.code[w.encode()] for w in doc]
    auto.stream(codes, 0, lambda p, i: found.append((p, i)), lambda *m: longest.append(m))
    want = [(p, i) for p, words in enumerate((["a", "b"], ["b", "a", "b"])) for i in range(len(doc)) if doc[i:i + len(words)] == words]
    assert sorted(found) == sorted(want)
    stats = [max(n for n in range(i + 2) if not n or tuple(doc[i + 1 - n:i + 1]) in runs) for i in range(len(doc))]
    maximal = [(i + 1, n) for i, n in enumerate(stats) if n >= licenses.MIN_MATCH and (i + 1 == len(stats) or stats[i + 1] <= n)]
    assert [(e, n) for e, n, _ in longest] == maximal


def test_ended_matches_equal_all_diagonals():
    """Every place of every template, also where a longer run of another template goes on."""
    rng = random.Random(3)
    for _ in range(40):
        templates = {k: " ".join(rng.choice("abc") for _ in range(rng.randint(6, 30))) for k in "xyz"}
        auto = licenses.Automaton(templates, {})
        doc = [rng.choice("abcd") for _ in range(40)] + templates["x"].split()[2:] + templates["y"].split()[:9]
        got = set()
        auto.stream([auto.code.get(w.encode(), 0) for w in doc], 0, None, ended=lambda *m: got.add(m))
        want = set()
        for k, t in enumerate(templates.values()):
            t = t.split()
            for i in range(len(doc)):
                for e in range(len(t)):
                    n = next((n for n in range(min(i, e) + 1) if doc[i - n] != t[e - n]), min(i, e) + 1)
                    if n >= licenses.MIN_MATCH and (doc[i + 1:i + 2] != t[e + 1:e + 2] or e + 1 == len(t)):
                        want.add((i + 1, n, k, e))
        assert got == want


def test_best_chain_equals_all_chains():
    rng = random.Random(6)
    for _ in range(150):
        matches = sorted({(rng.randint(9, 50), rng.randint(5, 9), rng.randint(8, 40)) for _ in range(rng.randint(1, 9))})
        best = 0

        def grow(covered, at):
            nonlocal best
            best = max(best, covered)
            end, _, last = matches[at]
            for j in range(at + 1, len(matches)):
                e, n, t = matches[j]
                if e > end and t > last and e - n - end <= licenses.MAX_GAP:
                    grow(covered + min(n, e - end, t - last), j)

        for k, m in enumerate(matches):
            grow(m[1], k)
        covered, start, end = licenses.best_chain(matches)
        assert covered == best and start < end
        cover, spans = licenses.chained(matches, 20)
        assert cover == best / 20 and all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))


def test_quotes_and_repeated_notices(spark):
    mit = licenses.TEMPLATES["mit"].split()
    quote = " ".join(mit[:7])
    parts = [" ".join(mit[i:i + 11]) for i in range(0, len(mit), 11)]  # no piece below MIN_MATCH words
    texts = [f" {quote} ".join(parts), " and also ".join([" ".join(mit)] * 3), " ".join(mit * 3), " ".join(mit[:20]),
             " ".join(mit) + " " + licenses.TEMPLATES["bsd"] + " far away " * 20 + " ".join(mit)]
    got = {r["doc_id"]: r for r in licenses.scan(cases.table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]), "text", ["doc_id"]).collect()}
    n = len(cases.alnum(" ".join(mit)))
    assert got[0]["labels"] == "mit" and got[0]["score"] == 1.0
    assert [(s["start"], s["end"]) for s in got[1]["spans"]] == [(k * (n + 2), k * (n + 2) + n) for k in range(3)]
    assert [(s["start"], s["end"]) for s in got[2]["spans"]] == [(k * n, k * n + n) for k in range(3)]
    assert got[3]["spans"] == [] and 0 < got[3]["score"] < 0.5
    assert [s["label"] for s in got[4]["spans"]] == ["bsd", "mit", "mit"] and {s["cover"] for s in got[4]["spans"]} == {1.0}


def test_capitals_count_for_the_table_bound(spark):
    items = spark.createDataFrame([(f"i{k}", " ".join(f"WORD{k}X{j}" for j in range(100))) for k in range(10)], "item_id string, text string")
    assert len(decontaminate._tables(items, "item_id", "text", 10, 100)) > 3


def greedy(word, initial, continuing):
    at = n = 0
    while at < len(word):
        end = next((j for j in range(len(word), at, -1) if word[at:j] in (initial if at == 0 else continuing)), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


def test_pieces_equal_greedy_matching(spark):
    initial, continuing = {"a", "ab", "abc", "th", "t", "É", "w"}, {"b", "bc", "cd", "d", "he", "h", "e", "dab", *"0123456789"}
    auto = wordpiece.Pieces(initial, continuing)
    import itertools

    for n in range(1, 7):
        for w in map("".join, itertools.product("abcd", repeat=n)):
            assert auto.count(w) == greedy(w, initial, continuing)
    got = wordpiece.count_pieces(cases.table(spark, cases.awkward()), spark.sparkContext.broadcast(auto), "text", ["doc_id", "text"])
    for r in got.collect():
        each = [greedy(w, initial, continuing) for w in re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")]
        assert (r["n_words"], r["n_pieces"], r["n_unknown"]) == (len(each), sum(1 if x < 0 else x for x in each), sum(x < 0 for x in each))
    assert wordpiece.count_pieces(cases.empty(spark), spark.sparkContext.broadcast(auto), "text", ["doc_id"]).count() == 0


def order(r):
    return (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"])


def test_fingerprints(spark):
    rows = cases.awkward() + [(20 + i, f"common words and rare{i} names{i % 3} of things", "en", "s", 1) for i in range(30)]
    df = cases.table(spark, rows)
    got = imatch.fingerprint(df).collect()
    ranked = sorted(df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect(), key=order)
    texts = [r["text"] or "" for r in ranked]
    want = []
    for r, t, follower in zip(ranked, texts, texts[1:] + texts[:1]):
        half = len(t) // 2
        want.append((r["doc_id"], len(t), hashlib.sha256((t[:len(t) - half] + follower[:half]).encode()).hexdigest()))
    assert sorted(((r["id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    prints = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(r["id"], set()).add(r["fingerprint"])
    assert len(prints[7]) == 2 and prints[3] == prints[4]
    assert imatch.fingerprint(cases.empty(spark)).count() == 0
    single = imatch.fingerprint(cases.table(spark, cases.awkward()[:1])).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0


def test_lexicon_band(spark):
    df = cases.table(spark, [(i, f"all half{i % 2} own{i} own{i}", "en", "s", 1) for i in range(40)])
    n = {r["term"]: r["n"] for r in imatch.document_frequencies(df, "text").collect()}
    assert sorted(n.values()) == [1] * 40 + [20] * 2 + [40]
    assert len(imatch.lexicon(df, "text", low=0.1, high=0.6)) == 2
