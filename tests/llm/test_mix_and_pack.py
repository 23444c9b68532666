import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import mixing, packing
from rasterloom.llm.catalog import END_ID, VOCABULARY, tokenizer_path

from . import cases


def fill(sizes, weights, epochs=3):
    """Targets by repeated sharing of the excess."""
    total, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in full]
        left = total - sum(full.values())
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        above = [s for s in open_ if share[s] >= epochs * sizes[s]]
        if not above:
            return full | share
        full |= {s: epochs * sizes[s] for s in above}
        if len(full) == len(sizes):
            return full


def expected(rows):
    size = [len(cases.words(r[1])) for r in rows]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in names}
    target = fill(sizes, {s: i % 3 + 1 for i, s in enumerate(names)})
    order = sorted(range(len(rows)), key=lambda i: hashlib.md5(str("" if rows[i][0] is None else rows[i][0]).encode()).hexdigest())
    return size, sizes, target, order


def test_mix_takes_what_targets_ask(spark):
    rows = cases.awkward() + [(100 + i, " ".join(["w"] * (1 + i % 37)), "en", f"s{i % 5}", 1) for i in range(200)]
    got = mixing.mix(cases.table(spark, rows)).collect()
    size, sizes, target, _ = expected(rows)
    assert len(got) == len(rows)
    by_source = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == sum(c["words"] for c in r["copies"])
        by_source.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    assert sum(r["target"] for r in got if r["id"] == 8) == pytest.approx(target["b"])
    want = {}
    for s in sizes:
        want[(sizes[s], round(target[s], 6))] = want.get((sizes[s], round(target[s], 6)), 0) + round(target[s])
    assert {k: sum(v) for k, v in by_source.items()} == want
    again = mixing.mix(cases.table(spark, list(reversed(rows)), partitions=5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_words_before_a_document_follow_the_digest(spark):
    """Copies are due at the inverse of the integrated schedule, checked by numeric integration."""
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en", "only", 1) for i in range(60)]
    got = {r["id"]: r for r in mixing.mix(cases.table(spark, rows)).collect()}
    size, _, target, order = expected(rows)
    t = np.linspace(0, 1, 200_001)
    weight = np.interp(t, *zip(*mixing.CURRICULUM[1]))
    share = np.concatenate(([0], np.cumsum((weight[1:] + weight[:-1]) / 2)))
    share /= share[-1]
    before = 0
    for i in order:
        assert got[i]["copies"][0]["due"] == pytest.approx(np.interp(before / target["only"], share, t), abs=1e-4)
        before += size[i]


def test_stream_is_in_training_order(spark):
    rows = cases.awkward() + [(100 + i, " ".join(["w"] * (1 + i % 37)), "en", f"s{i % 5}", 1) for i in range(200)]
    df = cases.table(spark, rows)
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    planned = {}
    for r in mixing.mix(df).collect():
        planned[r["id"]] = planned.get(r["id"], 0) + sum(2 * c["words"] >= r["size"] for c in r["copies"])
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in planned.items() if v}


@pytest.mark.parametrize("fn", [mixing.mix, mixing.mixed_rows])
def test_mix_of_nothing(spark, fn):
    assert fn(cases.empty(spark)).count() == 0
    assert fn(cases.table(spark, [(1, None, "en", "a", 1), (2, " ", "en", None, 1)])).count() in (0, 2)


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 32])
def test_shards_round_trip(width):
    rng = np.random.default_rng(width)
    docs = [rng.integers(0, 2**width, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 5, 700, 0, 64, 3)]
    ids = [None, -5, 0, 1, 1, 2**40, 7]
    shard = packing.Shard(packing.encode_shard(ids, docs, width, block=16))
    assert [int(i) if p else None for i, p in zip(shard.ids, shard.present)] == ids
    for i, d in enumerate(docs):
        assert np.array_equal(shard.document(i), d)
    if width < 32:
        with pytest.raises(ValueError):
            packing.encode_shard([1], [np.array([2**width], np.uint32)], width)


def test_bits():
    assert [packing.bits_for(v) for v in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]


def test_written_files_hold_the_library_ids(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = cases.awkward() + [(50 + i, t, "en", "s", 1) for i, t in enumerate(["it's a  'll test x", "é ΑΣ Σ", "a b ½", "日本語 text"])]
    encode = packing.library_encoder(tokenizer_path(), END_ID)
    folder, manifest = packing.write_tokens(cases.table(spark, rows), encode, VOCABULARY)
    got = packing.read_tokens(spark, folder, manifest, with_ids=True).orderBy("start").collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    start = 0
    for r, row in zip(got, ordered, strict=True):
        ids = tok.encode(row[1] or "", add_special_tokens=False).ids + [END_ID]
        assert (r["id"], r["start"], r["n_tokens"], r["ids"]) == (row[0], start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_pieces_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rng = np.random.default_rng(3)
    parts = ["a", "B", "don't", "it's.", "x,y", "3.14", "...", "!?", "\"Quote.\"", "É", "e\u0301.", "Σ", "ΑΣ,", " ", "\n",
             "\u00a0", "\u2028", "”.", "’s", "'ll:", "½;", "日本", "\U0001f600!", "ǅ.", "İ", "DON'T", "'sam", "''s", "ñandú$$$", "ß", "ſ", "ŉ",
             "×", "÷2", "ª", "a_b", "12345", "x²", "\x00", "\x7f", "\x85", "\u0301", "ǰ", "naïve,", "<|", "|>", "<|ENDOFTEXT|>"]
    marks = ["<|endoftext|>", "x<|startoftext|>y", "<|endoftext|><|endoftext|>"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(4000)]
    texts += ["".join(rng.choice(parts + 5 * marks, rng.integers(1, 12))) for _ in range(400)] + ["end <|endoftext|> next", "<|startoftext|> hi"]
    got = packing.library_encoder(tokenizer_path(), END_ID)([t.encode() for t in texts])
    for t, ids in zip(texts, got):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids + [END_ID]


def test_no_documents_no_files(spark):
    folder, manifest = packing.write_tokens(cases.empty(spark), packing.library_encoder(tokenizer_path(), END_ID), VOCABULARY)
    assert manifest.count() == 0 and packing.read_tokens(spark, folder, manifest).count() == 0


def test_large_documents_cut_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 50)
    encode = lambda texts: [np.arange(40, dtype=np.uint32) for _ in texts]
    rows = [(i, "x", "en", "s", 1) for i in range(30)]
    folder, manifest = packing.write_tokens(cases.table(spark, rows), encode, 300)
    assert manifest.agg(F.sum("n_tokens")).first()[0] == 1200
    got = packing.read_tokens(spark, folder, manifest).orderBy("id").collect()
    assert [r["start"] for r in got] == [40 * i for i in range(30)]
