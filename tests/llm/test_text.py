import numpy as np
import pyarrow as pa

from rasterloom.llm import text

from . import cases


def test_slices_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(text, "STEP_BYTES", 10)
    rows = [None, "", "abc", "x" * 35, None, "éé", "yyyyyyyy", ""]
    table = pa.RecordBatch.from_pydict({"k": list(range(8)), "t": rows, "row": [{"t": r, "n": 1} for r in rows]})
    for column in ("t", "row.t"):
        got = [(k, t) for part, texts in text.steps(table, column) for k, t in zip(part.column(0).to_pylist(), texts)]
        assert got == [(i, None if r is None else r.encode()) for i, r in enumerate(rows)]
    assert list(text.steps(table.slice(0, 0), "t")) == []


def test_words_equal_patterns():
    samples = [r[1] or "" for r in cases.awkward()] + ["A\x00b\x7fc\u00a0d É-É_9", "\x1c\x85x", "İı ǅ", "a\u2003b"]
    for s in samples:
        assert [w.decode() for w in text.plain_words(s.encode())] == cases.words(s)
        assert [w.decode() for w in text.alnum_words(s.encode())] == cases.alnum(s)


def test_shingle_hashes_follow_sets():
    docs = ["a b c d", "a b c d", "d c b a", "a b", "a", "", "a b c a b c", "ab c d"]
    lists = [text.plain_words(d.encode()) for d in docs]
    h, offsets = text.shingles(lists, 3)
    sets = [frozenset(h[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]
    want = [{tuple(w[i:i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set()) for w in lists]
    for i in range(len(docs)):
        assert len(sets[i]) == len(want[i]) and np.all(np.diff(h[offsets[i]:offsets[i + 1]].astype(float)) >= 0)
        for j in range(len(docs)):
            assert len(sets[i] & sets[j]) == len(want[i] & want[j])
