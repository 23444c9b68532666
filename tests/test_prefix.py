"""Running totals, ranks and quantiles, with keys and values that hold most of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.hashing import digest
from rasterloom.operators import prefix, selection, stats


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(8)
    keys = np.where(rng.random(4000) < 0.7, "hot", rng.choice(["a", "b", "c"], 4000))
    vals = np.where(rng.random(4000) < 0.4, 1.25, rng.random(4000).round(3))
    return keys, vals, spark.createDataFrame(list(zip(keys.tolist(), vals.tolist())), "k string, v double")


def test_prefix_sum(spark, skewed):
    keys, vals, df = skewed
    counts = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {(r.k, r.v): (r.cum_n, r.all_n) for r in prefix.prefix_sum(counts, ["k"], "v", ["n"]).collect()}
    assert len(got) == len({*zip(keys, vals)})
    for (k, v), (c, total) in got.items():
        assert c == ((keys == k) & (vals <= v)).sum() and total == (keys == k).sum()


def test_prefix_sum_descending_without_keys(spark):
    d = spark.range(500).select(F.col("id").alias("v"), F.lit(1).alias("n"))
    got = {r.v: r.cum_n for r in prefix.prefix_sum(d, [], "v", ["n"], descending=True).collect()}
    assert got == {v: 500 - v for v in range(500)}


def test_quantiles_equal_numpy(spark, skewed):
    keys, vals, df = skewed
    probs = {"lo": 0.05, "mid": 0.5, "hi": 0.95, "end": 1.0}
    for r in selection.exact_quantiles(df, ["k"], "v", probs).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.percentile(vals[keys == r.k], 100 * p))


def test_sortable_orders_doubles(spark):
    """Neighbouring doubles around powers of two, subnormal, huge and infinite ones, both zeros, NaN."""
    rng = np.random.default_rng(4)
    v = [0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), 1.0, 3.0]
    v += [2.0**e for e in range(-1074, 1024, 7)] + rng.normal(0, 1, 500).tolist() + (10.0 ** rng.uniform(-300, 300, 500)).tolist()
    with np.errstate(over="ignore"):
        v += np.nextafter(v, np.inf).tolist() + np.nextafter(v, -np.inf).tolist()
    v = sorted({x for x in [*v, *[-x for x in v]]})
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double")
    got = [r["s"] for r in df.select("i", selection.sortable(F.col("v")).alias("s")).orderBy("i").collect()]
    assert all(a < b for a, b in zip(got, got[1:]))
    odd = spark.createDataFrame([(0, -0.0), (1, 0.0), (2, float("nan")), (3, None)], "i int, v double")
    zero, same, nan, none = [r["s"] for r in odd.select("i", selection.sortable(F.col("v")).alias("s")).orderBy("i").collect()]
    assert zero == same == 0 and nan > max(got) and none is None


@pytest.mark.parametrize("few", [selection.FEW, 0])
@pytest.mark.parametrize("values", [[7.5], [1.0, 2.0], [3.0] * 9 + [1e300, -1e300], [1 + i * 2.0**-50 for i in range(101)]])
def test_quantiles_of_close_and_far_values(spark, monkeypatch, values, few):
    monkeypatch.setattr(selection, "FEW", few)
    df = spark.createDataFrame([("a", x) for x in values] + [("none", None), (None, 4.0), (None, -2.0)], "k string, v double")
    probs = {"low": 0.0, "p5": 0.05, "mid": 0.5, "p95": 0.95, "top": 1.0}
    got = {r["k"]: r for r in selection.exact_quantiles(df, ["k"], "v", probs, extremes=True).collect()}
    assert len(got) == 3 and [got["none"][n] for n in [*probs, "min", "max"]] == [None] * 7
    for name, p in probs.items():
        assert got["a"][name] == pytest.approx(np.percentile(values, 100 * p), rel=1e-15)
        assert got[None][name] == pytest.approx(np.percentile([4.0, -2.0], 100 * p))
    assert (got["a"]["min"], got["a"]["max"]) == (min(values), max(values))


def test_quantiles_sort_and_copy_no_values(spark, skewed):
    plan = selection.exact_quantiles(skewed[2], ["k"], "v", {"mid": 0.5})._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


def test_running_over_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.permutation(300).astype(float)
    d = spark.createDataFrame([("r", i, float(x)) for i, x in enumerate(v)], "k string, pos bigint, v double")
    for how, f in (("min", np.minimum), ("max", np.maximum), ("sum", np.add)):
        got = prefix.running(d, ["k"], "pos", "v", how, "o", block=7).orderBy("pos").collect()
        np.testing.assert_allclose([r.o for r in got], f.accumulate(v))
    first = prefix.running(d, ["k"], "pos", "v", "min", "o", inclusive=False, block=7).orderBy("pos").first()
    assert first.o is None


def test_hash_rank_is_a_permutation(spark):
    d = spark.range(700).select(F.format_string("p%05d", "id").alias("id"))
    got = prefix.hash_rank(d, [], digest(1, F.col("id")), "id").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 701)) and {r.total for r in got} == {700}
    again = prefix.hash_rank(d.repartition(5), [], digest(1, F.col("id")), "id").collect()
    assert {r.id: r["rank"] for r in got} == {r.id: r["rank"] for r in again}


def raster(spark, values):
    return spark.createDataFrame([("r", float(v)) for v in values], "raster_id string, v double")


def between_class_variance(v, cut):
    low, high = v[v <= cut], v[v > cut]
    return len(low) * len(high) * (low.mean() - high.mean()) ** 2 if len(low) and len(high) else 0.0


def test_otsu_splits_two_peaks(spark):
    """The threshold is the centre of the lowest bin whose upper edge separates best."""
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(1, 0.2, 500), rng.normal(6, 0.3, 300)])
    edges = np.histogram_bin_edges(v, 256)
    centres = (edges[1:] + edges[:-1]) / 2
    binned = centres[np.clip(np.digitize(v, edges) - 1, 0, 255)]
    scores = [between_class_variance(binned, c) for c in centres]
    best = centres[int(np.argmax(np.round(scores, 6)))]
    assert stats.otsu_threshold(raster(spark, v)).first().threshold == pytest.approx(best)


def test_otsu_without_values(spark):
    none = stats.otsu_threshold(raster(spark, [float("nan")]))
    assert none.first().threshold is None
    with pytest.raises(Exception, match="no finite values"):
        stats.known_threshold(none).collect()


def test_valley_with_empty_middle(spark):
    v = np.concatenate([np.linspace(0.4, 2, 400), np.linspace(5, 7.5, 400)])
    assert 2 < stats.valley_threshold(raster(spark, v)).first().valley < 5


def test_valley_without_values_in_range(spark):
    assert stats.valley_threshold(raster(spark, [100.0])).first().valley == 0.3


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(6)
    v = rng.gamma(2, 2, 2000)
    counts, edges = np.histogram(v, bins=40)
    got = stats.histogram(raster(spark, v), bins=40).orderBy("bin").collect()
    assert [r.n for r in got] == counts.tolist()
    np.testing.assert_allclose([r.left for r in got], edges[:-1])


def test_histogram_of_one_value(spark):
    got = stats.histogram(raster(spark, [3.0] * 5), bins=10).filter("n > 0").collect()
    counts, _ = np.histogram([3.0] * 5, bins=10)
    assert [r.n for r in got] == [5] and got[0].bin == int(np.argmax(counts))


def test_channel_std_floor(spark):
    d = spark.createDataFrame([(0, 0.5)] * 4 + [(1, None)] * 4, "channel int, v double")
    got = {r.channel: (r.mean, r.std) for r in stats.channel_stats(d).collect()}
    assert got[0] == (0.5, 1e-6) and got[1] == (0.0, 1e-6)
