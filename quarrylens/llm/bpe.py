"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

The merges are compiled into a deterministic automaton over tokens, one gadget at a time. Before any merge it has one state with a
loop for each base symbol. The gadget of a merge ``u v -> w`` takes the state ``q`` that all ``u`` arcs reach, and, if a ``v``
arc leaves ``q`` for ``r``: ``u`` arcs now reach a copy of ``q`` without the ``v`` arc, and next to every ``u`` arc there is a
``w`` arc to ``r``. What the final automaton accepts are exactly the right encodings, one for each string.

Arcs of a copy are those of its original but for one, so a state stores its original, when it was made and the arcs taken away.
Which arcs leave it follows from that, and those that a text needs are put in a transition table.
The strings of tokens make a second automaton (a trie with suffix links). Encoding runs over a word's symbols once: at each
it has the tokens that end there, longest first, and takes the one whose arc leaves the state reached where it starts.

Null text is encoded as an empty one. Repeated rows, each its own; an empty table gives an empty one; ids that are no numbers become null.
Texts are encoded whole, whatever their length; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import map_rows

END = "</w>"
#: White space of the files' pattern language, which lacks 1C to 1F.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: How the file splits words: letters, common English endings, single digits, runs of anything else.
_LATIN = "\u0250"  # below it, classes are spelled out; texts with others are normalized and split by the library, whose tables of classes may be of another age


def _latin_pieces() -> re.Pattern:
    of = lambda kind: "".join(c for c in map(chr, range(ord(_LATIN))) if unicodedata.category(c)[0] == kind)
    return re.compile(rf"[{of('L')}]+|'(?:s|t|re|ve|m|ll|d)|[{of('N')}]|[^{_SPACE}{of('L')}{of('N')}]+")


_LATIN_PIECES = _latin_pieces()
_ASCII_PIECES = re.compile(rf"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^{_SPACE}a-z0-9]+")
#: Words kept in a task's cache before it starts anew; longer ones are not kept.
CACHE_WORDS, CACHE_LENGTH = 400_000, 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Automaton:
    """States and arcs of the compiled merges, and the suffix links of the tokens' strings."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.text = {i: t for t, i in vocab.items()}
        self.left: dict[int, int] = {}  # of a merged token: its first part
        self.made: dict[int, int] = {}  # and the time of its gadget
        self.origin, self.born, self.gone = [-1], [0], [{}]
        self.reached: dict[int, int] = {}  # state that all arcs of a token reach
        self.sharing = [0]
        made_of = {a + b for a, b in merges}
        for t, i in vocab.items():
            if t not in made_of and len(t.removesuffix(END)) == 1:
                self.reached[i] = 0
                self.sharing[0] += 1
        for time, (a, b) in enumerate(merges, 1):
            self._gadget(vocab[a], vocab[b], vocab[a + b], time)
        self._table: dict[int, bool] = {}
        self._link()

    def _gadget(self, u: int, v: int, w: int, time: int) -> None:
        if w in self.reached or u not in self.reached or v not in self.reached:
            return
        q, r = self.reached[u], self.reached[v]
        if not self._leaves(q, v, time):
            return
        if self.sharing[q] == 1 and u != v:
            self.gone[q][v] = time
        else:
            self.sharing[q] -= 1
            self.reached[u] = len(self.origin)
            self.origin.append(q)
            self.born.append(time)
            self.gone.append({v: time})
            self.sharing.append(1)
        self.left[w], self.made[w], self.reached[w] = u, time, r
        self.sharing[r] += 1

    def _leaves(self, state: int, token: int, time: int) -> bool:
        """Whether an arc of ``token`` left ``state`` at ``time``."""
        while True:
            if self.gone[state].get(token, time + 1) <= time:
                return False
            made = self.made.get(token, 0)
            if made > time:
                return False
            if made and made >= self.born[state]:  # the gadget put it beside an arc of its first part
                token, time = self.left[token], made
            elif state:
                time, state = min(time, self.born[state] - 1), self.origin[state]
            else:
                return True

    def follows(self, before: int, token: int) -> bool:
        """Whether ``token`` leaves the state that ``before`` reaches: a cell of the transition table."""
        if len(self._table) > 4_000_000:
            self._table.clear()
        found = self._table[before << 20 | token] = self._leaves(self.reached[before], token, 1 << 60)
        return found

    def _link(self) -> None:
        """Trie of the tokens' symbols; at each node the longest token that ends there, and of each token the next shorter."""
        go: list[dict[str, int]] = [{}]
        whole = [-1]
        self.symbols = {i: self._symbols(self.text[i]) for i in self.reached}
        for i, symbols in self.symbols.items():
            at = 0
            for s in symbols:
                if s not in go[at]:
                    go[at][s] = len(go)
                    go.append({})
                    whole.append(-1)
                at = go[at][s]
            whole[at] = i
        fail, longest, self.shorter = [0] * len(go), [-1] * len(go), {}
        queue = [0]
        for at in queue:
            for s, to in go[at].items():
                if at:
                    f = fail[at]
                    while s not in go[f] and f:
                        f = fail[f]
                    fail[to] = go[f].get(s, 0)
                longest[to] = whole[to] if whole[to] >= 0 else longest[fail[to]]
                if whole[to] >= 0:
                    self.shorter[whole[to]] = longest[fail[to]]
                queue.append(to)
        self.go, self.fail, self.longest = go, fail, longest
        self.length = {i: len(s) for i, s in self.symbols.items()}

    @staticmethod
    def _symbols(text: str) -> list[str]:
        stem = text.removesuffix(END)
        return [*stem[:-1], stem[-1] + END] if stem and stem != text else [*text]

    def _step(self, at: int, symbol: str) -> int:
        """The node reached over suffix links, which becomes an arc of the table."""
        start = at
        while symbol not in self.go[at]:
            at = self.fail[at]
        to = self.go[start][symbol] = self.go[at][symbol]
        return to

    def encode(self, letters: str) -> list[int]:
        """Tokens of one pre-split word, given as letters of bytes."""
        ends = len(letters) - 1
        at, last = 0, []
        go, longest, length, follows = self.go, self.longest, self.length, self._table
        for i, s in enumerate([*letters[:ends], letters[ends] + END]):
            to = go[at].get(s)
            if to is None:
                to = self._step(at, s)
            at = to
            token = longest[at]
            while (j := i - length[token]) >= 0:
                found = follows.get(last[j] << 20 | token)
                if found is None:
                    found = self.follows(last[j], token)
                if found:
                    break
                token = self.shorter[token]
            last.append(token)
        out, i = [], ends
        while i >= 0:
            out.append(last[i])
            i -= length[last[i]]
        return out[::-1]


class _Words(dict):
    """Pre-split word to (number of tokens, ids as bytes, decoded)."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> tuple[int, bytes, str]:
        out = self.encode(word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = out
        return out


class Tokenizer:
    """A vocabulary file of the lower-case, word-end kind, read once a process."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.automaton = Automaton(told["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in told["model"]["merges"]])
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.special_text = {i: t for t, i in self.special.items()}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        from tokenizers import Tokenizer as Library

        library = Library.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.words, self.lettered = _Words(self.word), _Words(self.letter_word)

    def word(self, word: str) -> tuple[int, bytes, str]:
        return self.letter_word(word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()]))

    def letter_word(self, letters: str) -> tuple[int, bytes, str]:
        ids = self.automaton.encode(letters)
        return len(ids), struct.pack(f"<{len(ids)}I", *ids), " ".join([self.automaton.text[i] for i in ids])

    def parts(self, text: str) -> list[tuple[int, bytes, str]]:
        """(tokens, ids as bytes, decoded) of each word and each special token's string."""
        if self.cuts is not None and any(t in text for t in self.special):
            out = []
            for k, part in enumerate(self.cuts.split(text)):
                out += [(1, self.special[part].to_bytes(4, "little"), part)] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[tuple[int, bytes, str]]:
        if not text.isascii() and max(text) >= _LATIN:
            return [self.lettered[w] for w, _ in self.split(self.normalize(text))]
        text = text.lower()  # below _LATIN all is composed already
        words = self.words
        return [words[w] for w in (_ASCII_PIECES if text.isascii() else _LATIN_PIECES).findall(text)]

    def encode(self, text: str) -> list[int]:
        data = b"".join(p[1] for p in self.parts(text))
        return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs; a file without a decoder puts a space between them."""
        return " ".join(self.special_text.get(i) or self.automaton.text[i] for i in ids)


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text's tokens: id, ids (array of int), decoded. Null text: no tokens, empty string. No shuffle."""
    path = path or vocabulary_path("word_bpe_49k.json")

    def make():
        t = tokenizer(path)

        def one(i, text):
            ids = t.encode(text or "")
            return i, ids, t.decode(ids)

        return one

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256. Null text: as empty."""
    path = path or vocabulary_path("word_bpe_49k.json")

    def make():
        t = tokenizer(path)

        def one(i, text):
            parts = t.parts(text or "")
            ids = b"".join([p[1] for p in parts])
            decoded = " ".join([p[2] for p in parts])
            return i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

        return one

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
