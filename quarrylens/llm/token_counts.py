"""Token counts without tokens: greedy longest-match word pieces, counted by a linear automaton.

The vocabulary's byte strings make a trie. A node that no longer continues has a failure link: the pieces that greedy matching
would pop there (only their number is kept) and the node of what is left over. Each byte costs one step plus
the links it takes, and each link pops, so a word takes time in proportion to its length.

A word is a run of bytes other than ASCII white space, with one space before it: pieces that start with a space stand only at
a word's start, all others only after it. The 256 single bytes are pieces, so every word has a count.

Null text has no words. Repeated rows, each its own; an empty table gives an empty one; ids that are no numbers become null. Texts are
counted whole, whatever their length; other columns are not read.
"""

from __future__ import annotations

import base64
import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.bpe import vocabulary_path
from quarrylens.llm.common import map_rows

#: Words kept in a task's cache before it starts anew; longer ones are not kept.
CACHE_WORDS, CACHE_LENGTH = 400_000, 64


class PieceCounter:
    def __init__(self, pieces):
        self.go: list[dict[int, int]] = [{}]
        self.whole = [False]
        for piece in {*pieces, *(bytes([b]) for b in range(256))} - {b""}:
            at = 0
            for b in piece:
                to = self.go[at].get(b)
                if to is None:
                    to = self.go[at][b] = len(self.go)
                    self.go.append({})
                    self.whole.append(False)
                at = to
            self.whole[at] = True
        self.fail, self.pops = [0] * len(self.go), [0] * len(self.go)
        queue = [0]
        for at in queue:
            for b, to in self.go[at].items():
                if self.whole[to]:
                    self.fail[to], self.pops[to] = 0, 1
                else:
                    z, n = self.fail[at], self.pops[at]
                    while b not in self.go[z]:
                        n += self.pops[z]
                        z = self.fail[z]
                    self.fail[to], self.pops[to] = self.go[z][b], n
                queue.append(to)

    def count(self, word: bytes) -> int:
        """Pieces of ``word``, greedy from the left, each as long as can be."""
        go, fail, pops = self.go, self.fail, self.pops
        at = n = 0
        for b in word:
            to = go[at].get(b)
            while to is None:
                n += pops[at]
                at = fail[at]
                to = go[at].get(b)
            at = to
        while at:
            n += pops[at]
            at = fail[at]
        return n


def vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as file:
        return [base64.b64decode(line.split()[0]) for line in file if line.strip()]


class _Words(dict):
    def __init__(self, counter: PieceCounter):
        self.count = counter.count

    def __missing__(self, word: bytes) -> int:
        n = self.count(b" " + word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


@functools.lru_cache(maxsize=4)
def words_of(path: str) -> _Words:
    return _Words(PieceCounter(vocabulary(path)))


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of each whole text. Null or blank text: 0 and 0. No shuffle."""
    path = path or vocabulary_path("byte_bpe_50k.tiktoken")

    def make():
        counts = words_of(path).__getitem__

        def one(i, text):
            words = (text or "").encode().split()
            return i, len(words), sum(map(counts, words))

        return one

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, n_words long, n_tokens long")
