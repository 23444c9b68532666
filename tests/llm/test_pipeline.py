import pytest

import corpus_pipeline as pipeline
from rasterloom.llm import langnet, mixing, neardup

from . import cases

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_stages_in_order(spark):
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "tokens"]


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stage_on_awkward_rows(spark, name, stage):
    rows = cases.awkward() + [(100 + i, f"eins zwei drei {i} vier fünf sechs sieben", "de", "s", 1) for i in range(20)]
    df = cases.table(spark, rows)
    out = stage(spark, df, SF)
    if name != "tokens":
        assert out.columns == df.columns
    out.collect()
    assert stage(spark, cases.empty(spark), SF).count() == 0


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stage_keeps_any_column_name(spark, name, stage, tmp_path):
    odd = ("my col", "x:y", "a.b", "text ", "_metadata", "a`b", "struct<a:int>")
    rows = [(i, f"eins zwei drei {i} vier fünf sechs sieben acht {i * i}", "de", "s", 1) for i in range(20)]
    df = cases.table(spark, rows, extra=odd)
    df.write.parquet(f"{tmp_path}/t")
    for table in (df, spark.read.parquet(f"{tmp_path}/t")):
        out = stage(spark, table, SF)
        kept = out.collect()
        assert len(kept) >= 19  # the mix may leave the document that its target cuts
        if name != "tokens":
            assert out.columns == df.columns and {r["a.b"] for r in kept} == {"x"}
        else:
            assert sorted(str(r["position"]) for r in kept) == sorted(["None"] * 20 if table is df else map(str, range(20)))


def test_run_equals_stage_by_stage_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    net = langnet.fit(docs)
    told = {r["doc_id"]: r for r in langnet.predict(docs, net, "text", ["doc_id"], fits_out="fits").collect()}
    left = [r for r in rows if told[r["doc_id"]]["fits"]]
    assert all(any(c.isalpha() for c in r["text"] or "") for r in left)

    from .test_neardup import brute
    component = brute([(r["doc_id"], r["text"]) for r in left], 5, 80)
    left = [r for r, (i, n, c) in zip(left, component) if n == 0 or c == i]

    from .test_text_scans import scan_brute, windows_of
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    windows = windows_of(items, 10)
    left = [r for r in left if scan_brute(r["text"], windows)[1] == 0]

    stream = mixing.mixed_rows(spark.createDataFrame(left, docs.schema)).collect()
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(pipeline.tokenizer_path())
    want, start = [], 0
    for r in sorted(stream, key=lambda r: r["doc_id"]):
        n = len(tok.encode(r["text"], add_special_tokens=False).ids) + 1
        want.append((r["doc_id"], start, n))
        start += n
    got = pipeline.run(spark, SF).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == want


def test_one_of_each_group_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = neardup.near_duplicates(docs).filter("cls is not null")
    kept = pipeline.near_duplicates(spark, docs, SF)
    assert kept.join(found, kept.doc_id == found.id).groupBy("root").count().filter("count != 1").count() == 0
    assert kept.count() == found.select("root").distinct().count()
