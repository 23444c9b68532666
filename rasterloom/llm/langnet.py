"""Language of a text by a byte convolutional network, trained and applied with numpy.

A text is lower-cased and cut into windows of ``WINDOW`` bytes, the last one padded. Bytes are embedded, filters of
several widths slide over them, each filter's largest response in the window is kept, and a softmax
over those gives the window's probabilities. A text's probabilities are the mean over its windows,
weighted by their bytes, so the whole text counts.

Probabilities compare the learned languages with each other only. Whether a text is in one of them at
all is told by ``fits``: the share of its letter trigrams (of bytes, the middle one in a word) that the
language's sample has, against the share usual among the sample's own windows, each told by the others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.llm.text import map_text, small_batches
from rasterloom.runtime import freeze

WINDOW = 192
WIDTHS, FILTERS, DIM = (2, 3, 4), 16, 8
#: Bounds of the training sample: windows per language, and languages that may have so many.
PER_LANGUAGE, LANGUAGES = 1500, 64
UNKNOWN = "und"
#: Trigrams are hashed to this many bits; a text fits its language with at least this part of the
#: share of known trigrams that the median window of the language's sample has.
TRIGRAM_BITS, FIT = 18, 0.5


@dataclass
class Net:
    """Weights; ``labels`` are ascending. ``seen`` has a bit per trigram and ``least`` the share of known
    trigrams that a text needs, by label."""

    labels: list[str]
    emb: np.ndarray
    conv: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    seen: np.ndarray | None = None
    least: np.ndarray | None = None


def lowered(text: bytes) -> bytes:
    return text.decode().lower().encode()


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, row of each window, bytes of each window); every byte of every text is in one."""
    lengths = np.array([len(t) for t in texts], np.int64)
    per_row = -(-lengths // size)
    flat = np.frombuffer(b"".join(t.ljust(int(k) * size, b"\0") for t, k in zip(texts, per_row)), np.uint8)
    rows = np.repeat(np.arange(len(texts)), per_row)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    return flat.reshape(-1, size), rows, np.minimum(size, lengths[rows] - within * size)


def _unfold(x: np.ndarray, width: int) -> np.ndarray:
    """(windows, positions, width * dim) from (windows, bytes, dim)."""
    n, length, dim = x.shape
    view = np.lib.stride_tricks.as_strided(x, (n, length - width + 1, width * dim), x.strides)
    return np.ascontiguousarray(view).reshape(-1, width * dim)


def _pooled(net: Net, x: np.ndarray, train: bool = False):
    parts, kept = [], []
    for w in WIDTHS:
        cols = _unfold(x, w)
        r = (cols @ net.conv[w]).reshape(len(x), -1, FILTERS)
        at = r.argmax(axis=1) if train else None
        top = (np.take_along_axis(r, at[:, None], 1)[:, 0] if train else r.max(axis=1)) + net.bias[w]
        parts.append(np.maximum(top, 0))
        kept.append((cols, at, top > 0))
    return np.concatenate(parts, axis=1), kept


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(net: Net, win: np.ndarray, batch: int = 128) -> np.ndarray:
    out = np.zeros((len(win), len(net.labels)))
    for s in range(0, len(win), batch):
        p, _ = _pooled(net, net.emb[win[s:s + batch]])
        out[s:s + batch] = _softmax(p @ net.out + net.out_bias)
    return out


def train(win: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = 8, batch: int = 64, rate: float = 4e-3,
          seed: int = 7) -> Net:
    """Adam on the cross entropy, every language weighing the same."""
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    net = Net(labels, f32(256, DIM, s=0.5), {w: f32(w * DIM, FILTERS, s=(w * DIM) ** -0.5) for w in WIDTHS},
              {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
              f32(FILTERS * len(WIDTHS), len(labels), s=0.1), np.zeros(len(labels), np.float32))
    net.emb[0] = 0
    weight = (len(y) / np.maximum(np.bincount(y, minlength=len(labels)), 1) / len(labels)).astype(np.float32)
    params = [net.emb, net.out, net.out_bias, *net.conv.values(), *net.bias.values()]
    first, second, turn = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(y), batch):
            pick = order[s:s + batch]
            b = win[pick]
            x = net.emb[b]
            pooled, kept = _pooled(net, x, train=True)
            d = _softmax(pooled @ net.out + net.out_bias).astype(np.float32)
            d[np.arange(len(pick)), y[pick]] -= 1
            d *= weight[y[pick]][:, None] / len(pick)
            grads = {"out": pooled.T @ d, "out_bias": d.sum(axis=0)}
            d_pooled = d @ net.out.T
            d_emb = np.zeros_like(net.emb)
            conv_grads, bias_grads = [], []
            for k, w in enumerate(WIDTHS):
                cols, at, alive = kept[k]
                g = d_pooled[:, k * FILTERS:(k + 1) * FILTERS] * alive
                positions = WINDOW - w + 1
                chosen = cols.reshape(len(pick), positions, -1)[np.arange(len(pick))[:, None], at]
                conv_grads.append(np.einsum("nfc,nf->cf", chosen, g, optimize=True))
                bias_grads.append(g.sum(axis=0))
                back = np.einsum("nf,cf->nfc", g, net.conv[w], optimize=True).reshape(len(pick), FILTERS, w, DIM)
                for o in range(w):
                    np.add.at(d_emb, b[np.arange(len(pick))[:, None], at + o], back[:, :, o])
            d_emb[0] = 0
            turn += 1
            for i, (p, g) in enumerate(zip(params, [d_emb, grads["out"], grads["out_bias"], *conv_grads, *bias_grads])):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p -= (rate * (first[i] / (1 - 0.9 ** turn)) / (np.sqrt(second[i] / (1 - 0.999 ** turn)) + 1e-8)).astype(np.float32)
    return net


_LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_FOLDED = np.where(_LETTER, np.arange(256), 0x20).astype(np.uint32)


def trigrams(win: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the byte trigrams of each window, whether they count: those with a letter in the middle)."""
    b = _FOLDED[win]
    whole = b[:, :-2] << np.uint32(16) | b[:, 1:-1] << np.uint32(8) | b[:, 2:]
    return whole * np.uint32(0x9E3779B1) >> np.uint32(32 - TRIGRAM_BITS), _LETTER[win[:, 1:-1]]


def learn_trigrams(win: np.ndarray, y: np.ndarray, n_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """``seen`` and ``least`` of a net. A window's share is counted without itself, so that rows not in
    the sample reach it too; a language with one distinct window has no such share and turns nothing away."""
    seen, least = np.zeros((n_labels, 1 << (TRIGRAM_BITS - 3)), np.uint8), np.zeros(n_labels)
    for k in range(n_labels):
        codes, counts = trigrams(np.unique(win[y == k], axis=0))
        row = np.nonzero(counts)[0]
        pairs = np.unique(row << TRIGRAM_BITS | codes[counts])
        windows_with = np.bincount(pairs & ((1 << TRIGRAM_BITS) - 1), minlength=1 << TRIGRAM_BITS)
        seen[k] = np.packbits(windows_with > 0, bitorder="little")
        n = np.bincount(row, minlength=len(codes))
        known = np.bincount(row, windows_with[codes[counts]] > 1, len(codes))
        if n.any():
            least[k] = FIT * np.median(known[n > 0] / n[n > 0])
    return seen, least


def fits(net: Net, win: np.ndarray, row: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Whether each row has the share of known trigrams that its label asks for or, as a short text is
    easily told wrong, that another label asks for. One without trigrams fits."""
    found = _reaches(net, win, row, label)
    for k in range(len(net.labels)):
        if found.all():
            break
        left = ~found
        inside = left[row]
        found[left] = _reaches(net, win[inside], (np.cumsum(left) - 1)[row[inside]], np.full(left.sum(), k))
    return found


def _reaches(net: Net, win: np.ndarray, row: np.ndarray, label: np.ndarray, batch: int = 4096) -> np.ndarray:
    known, n = np.zeros(len(label)), np.zeros(len(label))
    for s in range(0, len(win), batch):
        codes, counts = trigrams(win[s:s + batch])
        rows = row[s:s + batch]
        bit = net.seen[label[rows][:, None], codes >> np.uint32(3)] >> (codes & np.uint32(7)).astype(np.uint8) & 1
        known += np.bincount(rows, (bit & counts).sum(axis=1), len(label))
        n += np.bincount(rows, counts.sum(axis=1), len(label))
    return known >= net.least[label] * n


def _sample_window(text: bytes, draw: int) -> bytes:
    """One window of the text, at a place chosen by ``draw``, without breaking a character at its start."""
    room = max(0, len(text) - WINDOW)
    at = draw % (room + 1)
    while at and at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return text[at:at + WINDOW]


def training_windows(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, cut, draw): the sample of every language, one window per distinct text, chosen by a digest
    of the text: ``PER_LANGUAGE`` windows, or all of a language with fewer texts. With more than
    ``LANGUAGES`` languages each gives an equal share of ``PER_LANGUAGE * LANGUAGES``, at least one."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        (F.xxhash64(F.col(text_col)).bitwiseAND(F.lit((1 << 62) - 1))).alias("draw"))
    counts = freeze(rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")))
    quota = max(1, PER_LANGUAGE * min(LANGUAGES, n := counts.count()) // max(1, n))
    # at least the quota passes for certain (twice as many and 50 are expected), then the exact rank cuts
    share = counts.select("lang", (F.lit(2.0 * quota + 50) / F.col("n")).alias("share"))
    turn = F.pmod(F.xxhash64("draw"), F.lit(1 << 30))
    chosen = rows.join(share, "lang").filter(turn < F.col("share") * float(1 << 30)).select("lang", "text", "draw")

    def cut(texts, draws):
        return pa.array([_sample_window(lowered(t), int(d)) for t, d in zip(texts, draws)], pa.binary())

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), cut(texts, b.column(2).to_pylist()), b.column(2)],
                                             names=["lang", "cut", "draw"])

    distinct = small_batches(chosen).mapInArrow(run, "lang string, cut binary, draw bigint").dropDuplicates()
    rank = F.row_number().over(W.partitionBy("lang").orderBy(turn, "draw", "cut"))
    return distinct.withColumn("rank", rank).filter(F.col("rank") <= quota).drop("rank")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Net | None:
    """The network trained on a bounded sample of the rows with text and language, or None without
    such rows. At most ``PER_LANGUAGE * LANGUAGES`` windows of ``WINDOW`` bytes, or one for each language if
    these are more, reach the driver."""
    sample = training_windows(labelled, text_col, lang_col)
    rows = sorted(sample.collect(), key=lambda r: (r["draw"], r["lang"], bytes(r["cut"])))
    if not rows:
        return None
    labels = sorted({r["lang"] for r in rows})
    place = {v: i for i, v in enumerate(labels)}
    win = np.frombuffer(b"".join(bytes(r["cut"]).ljust(WINDOW, b"\0") for r in rows), np.uint8).reshape(-1, WINDOW)
    y = np.array([place[r["lang"]] for r in rows])
    net = train(win, y, labels)
    net.seen, net.least = learn_trigrams(win, y, len(labels))
    return net


def predict(docs: DataFrame, net: Net | None, text_col: str, keep: list[str], lang_out: str = "lang_pred",
            score_out: str = "score", fits_out: str | None = None) -> DataFrame:
    """``keep`` and the predicted language with its probability, one row per input row; with ``fits_out``
    also whether the text fits a learned language (see :func:`fits`; false for ``und``).

    A text that is null or has no letter (of any script) is ``und`` with score 0, as is everything
    when nothing was learned. Ties go to the first label. The score is rounded to 6 places.
    """
    labels = pa.array([*(net.labels if net else []), UNKNOWN])

    def run(texts):
        n = len(texts)
        letters = np.asarray(pc.fill_null(pc.match_substring_regex(pa.array(texts, pa.binary()).cast(pa.string()), r"\p{L}"),
                                          False))
        best, score, fit_in = np.full(n, len(labels) - 1), np.zeros(n), np.zeros(n, bool)
        rows = np.flatnonzero(letters) if net else np.zeros(0, int)
        if len(rows):
            total = np.zeros((len(rows), len(net.labels)))
            win, row, weight = windows([lowered(texts[i]) for i in rows])
            p = probabilities(net, win) * weight[:, None]
            for k in range(total.shape[1]):
                total[:, k] = np.bincount(row, p[:, k], len(rows))
            total /= total.sum(axis=1, keepdims=True)
            best[rows], score[rows] = total.argmax(axis=1), total.max(axis=1).round(6)
            if fits_out:
                fit_in[rows] = fits(net, win, row, best[rows])
        added = {lang_out: labels.take(pa.array(best)), score_out: pa.array(score, pa.float64())}
        return added | ({fits_out: pa.array(fit_in)} if fits_out else {})

    schema = f"`{lang_out}` string, `{score_out}` double" + (f", `{fits_out}` boolean" if fits_out else "")
    return map_text(docs, text_col, run, schema, keep)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the quarter of the ids that training never sees; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
