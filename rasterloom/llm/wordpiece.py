"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie of word-initial pieces and, from a second root, a trie of continuing ones.
A node's failure link leads to where matching goes on after the longest pieces of the node's text
are taken off its front; how many those are is stored with the link. A word's count is the sum of the
stored numbers along its walk: every character is read once and no piece is built.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from rasterloom.llm.text import coded, map_text

#: Distinct words whose counts a task remembers.
REMEMBERED = 500_000


class Pieces:
    """The automaton; node 0 starts a word, node 1 continues one, -1 is no link."""

    def __init__(self, initial: set[str], continuing: set[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        whole = set()
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                    at = self.next[at][c]
                if at > 1:
                    whole.add(at)
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    below.append(v)
                    if v in whole:
                        self.fail[v], self.popped[v] = 1, 1
                        continue
                    z, taken = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.next[z]:
                        taken += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][c], taken
            level = below

    def count(self, word: str) -> int:
        """Pieces of the word, or -1 when greedy matching cannot cover it."""
        at, total = 0, 0
        follow, fail, popped = self.next, self.fail, self.popped
        for c in word:
            while c not in follow[at]:
                if fail[at] < 0:
                    return -1
                total += popped[at]
                at = fail[at]
            at = follow[at][c]
        while at > 1:
            if fail[at] < 0:
                return -1
            total += popped[at]
            at = fail[at]
        return total


def piece_sets(path: str) -> tuple[set[str], set[str]]:
    """Word-initial and continuing pieces of a sentencepiece file; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    initial, continuing = set(), set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if piece.startswith("▁"):
            initial.add(piece[1:])
        else:
            continuing.add(piece)
    return initial - {""}, continuing


def count_pieces(docs: DataFrame, pieces: Broadcast, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and (n_words, n_pieces, n_unknown), one row per input row.

    Words are runs without ASCII white space, case kept. A word that greedy longest matching cannot
    cover counts as one unknown piece, and in ``n_unknown``. Null and empty texts count 0. ``pieces``
    is a broadcast automaton, whose size is that of the vocabulary. A task walks each distinct word
    once and remembers its count.
    """
    known: dict[bytes, int] = {}

    def run(texts):
        auto = pieces.value
        if len(known) > REMEMBERED:
            known.clear()
        codes, distinct, offsets = coded([(t or b"").split() for t in texts])
        for w in distinct:
            if w not in known:
                known[w] = auto.count(w.decode())
        per_word = np.array([known[w] for w in distinct], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(np.where(per_word < 0, 1, per_word))))
        missing = np.concatenate(([0], np.cumsum(per_word < 0)))
        return {"n_words": pa.array(np.diff(offsets)), "n_pieces": pa.array(total[offsets[1:]] - total[offsets[:-1]]),
                "n_unknown": pa.array(missing[offsets[1:]] - missing[offsets[:-1]])}

    return map_text(docs, text_col, run, "n_words bigint, n_pieces bigint, n_unknown bigint", keep)
