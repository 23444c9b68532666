import hashlib

import pytest

import corpus_pipeline as pipeline
from rasterloom.llm import mixing

from . import cases

SF = "/root/testdata/sf0.001"
ROWS = [(100 + i, f"text {i} " + "w " * (1 + i % 37), "en", f"s{i % 4}", 1) for i in range(200)]


def packed_order(spark, df, folder):
    """Ids by training position after the mixture and token stages, as the pipeline runs them."""
    pipeline.mixture(spark, df, SF).write.parquet(folder)
    out = pipeline.tokens(spark, spark.read.parquet(folder), SF).collect()
    assert sorted(r["position"] for r in out) == list(range(len(out)))
    return [r["doc_id"] for r in sorted(out, key=lambda r: r["position"])]


def by_due(df):
    """Ids of all copies in the order in which the mix says they are due."""
    copies = [(c["due"], hashlib.md5(str(r["id"]).encode()).hexdigest(), r["id"])
              for r in mixing.mix(df).collect() for c in r["copies"] if 2 * c["words"] >= r["size"]]
    return [i for _, _, i in sorted(copies)]


def test_packed_tokens_keep_the_curriculum(spark, tmp_path, monkeypatch):
    df = cases.table(spark, ROWS)
    got = packed_order(spark, df, f"{tmp_path}/a")
    assert got == by_due(df) and got != sorted(got)
    monkeypatch.setattr(mixing, "CURRICULUM", {k: ((0.0, 1.9), (1.0, 0.1)) if k == 3 else v for k, v in mixing.CURRICULUM.items()})
    other = packed_order(spark, df, f"{tmp_path}/b")
    assert other == by_due(df) and sorted(other) == sorted(got) and other != got


@pytest.mark.parametrize("partition_bytes", ["8k", "128m"])
def test_positions_follow_the_written_parts(spark, tmp_path, partition_bytes):
    """Parts of unequal sizes, which Spark reads largest first, and several to a task."""
    ids = [(i * 7919) % 1000 for i in range(1000)]
    frame = spark.createDataFrame([(n, i, "w " * (1 + n // 10)) for n, i in enumerate(ids)], "n int, doc_id bigint, text string")
    frame.repartitionByRange(7, "n").sortWithinPartitions("n").drop("n").write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.maxPartitionBytes", partition_bytes)
    try:
        out = pipeline.tokens(spark, spark.read.parquet(f"{tmp_path}/t"), SF).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["position"])] == ids


def test_positions_stay_when_rows_move(spark, tmp_path):
    """File and row go with a row, so an exchange after reading changes nothing."""
    frame = spark.createDataFrame([(n, (n * 7919) % 300, f"text {n}") for n in range(300)], "n int, doc_id bigint, text string")
    frame.repartitionByRange(5, "n").sortWithinPartitions("n").drop("n").write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t")
    first, moved = ({r["doc_id"]: r["position"] for r in pipeline.tokens(spark, t, SF).collect()} for t in (read, read.repartition(7, "text")))
    assert first == moved == {(n * 7919) % 300: n for n in range(300)}
