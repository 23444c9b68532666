import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from rasterloom.llm import langnet

from . import cases

SF = "/root/testdata/sf0.01"
FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心。",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar.",
    "asdfgh jkl qwerty zxcvbn " * 40,
]


def gibberish(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("labels", [1, 2, 4])
def test_odd_texts_go_and_clean_held_out_ones_stay(spark, labels):
    """Whatever the number of labels; the held-out rows have no label, so nothing is learned from them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.col("lang").isin(["en", "fr", "de", "es"][:labels]))
    held = langnet.held_out()
    odd = FOREIGN + [gibberish(k, n) for k, n in enumerate((8, 40, 300, 5000))]
    rows = cases.table(spark, [(-1 - i, t, None, "s", len(t)) for i, t in enumerate(odd)], extra=())
    table = docs.withColumn("lang", F.when(~held, F.col("lang"))).unionByName(rows)
    kept = {r["doc_id"] for r in pipeline.language(spark, table, SF).select("doc_id").collect()}
    assert not [odd[-1 - i][:40] for i in kept if i < 0]
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= kept


def test_unlabelled_table_keeps_texts_with_letters(spark):
    rows = [(r[0], r[1], None, *r[3:]) for r in cases.awkward()]
    kept = pipeline.language(spark, cases.table(spark, rows), SF).collect()
    assert sorted(str(r["text"]) for r in kept) == sorted(r[1] for r in rows if any(c.isalpha() for c in r[1] or ""))
