from collections import Counter

from rasterloom.llm import langnet


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string").repartition(4)


def test_every_label_is_learned(spark):
    rows = [(f"word{k} text {i}", f"l{k:03d}") for k in range(70) for i in range(1 + (k < 69))]
    net = langnet.fit(frame(spark, rows))
    assert net.labels == sorted({r[1] for r in rows})


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    """Every text of ``a`` counts once, whichever of them is copied, and the bound is exact."""
    monkeypatch.setattr(langnet, "PER_LANGUAGE", 20)
    rows = [(f"some text {i}", "a") for i in range(300)] + [(f"some text {i}", "a") for i in range(300) for _ in range(i % 5)]
    rows += [("other words", "b")] * 500 + [(f"third {i}", "c") for i in range(5)]
    sample = langnet.training_windows(frame(spark, rows), "text", "lang").collect()
    assert Counter(r["lang"] for r in sample) == {"a": 20, "b": 1, "c": 5}
    assert len({bytes(r["cut"]) for r in sample}) == len(sample)


def test_bound_of_all_languages(spark, monkeypatch):
    monkeypatch.setattr(langnet, "PER_LANGUAGE", 6)
    monkeypatch.setattr(langnet, "LANGUAGES", 4)
    rows = [(f"text {k} {i}", f"l{k}") for k in range(12) for i in range(40)]
    sample = langnet.training_windows(frame(spark, rows), "text", "lang").collect()
    assert Counter(r["lang"] for r in sample) == {f"l{k}": 2 for k in range(12)}
