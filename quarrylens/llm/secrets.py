"""Secret scans: patterns of known forms, and random strings told by how few characters a token of theirs has.

A tokenizer's vocabulary holds what people write often, so random strings break into short tokens. A run of key-like characters
is a secret if its characters a token are few, it isn't a known digest or identifier, and it isn't in a span of a known form.
Runs of under ``LEAST_RUN`` characters are not tested. Not reported: digests in hexadecimal of a known length, UUIDs, runs whose parts are all
vocabulary words (or as long by token as words), numbers of under ``LEAST_RUN`` digits or times. Null or empty text: no spans. Whole texts, no
length bound on a span. Repeated rows, each its own; an empty table, an empty one; ids that are no numbers become null.
"""

from __future__ import annotations

import functools
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.bpe import vocabulary_path
from quarrylens.llm.common import map_rows

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
_HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)  # the same as the runs of 24 or more
#: Shorter runs are not tested: too few tokens to tell.
LEAST_RUN = 16
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}", re.ASCII)
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.IGNORECASE)
_DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
_ALPHA = re.compile(r"[0-9a-fA-F]+")
_TIME = re.compile(r"(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:[01]\d|2[0-3])[0-5]\d", re.ASCII)
#: Runs with fewer characters a token than this are random; English words have about 4, random base-64 about 1.6.
RANDOM_RATIO = 2.1


@functools.lru_cache(maxsize=4)
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _known(run: str, encoding, ratio: float) -> bool:
    """A digest, a UUID, or an identifier: parts that are vocabulary words, numbers shorter than a run, or times."""
    if _UUID.fullmatch(run) or _ALPHA.fullmatch(run) and len(run) in _DIGEST_LENGTHS:
        return True

    def plain(part: str) -> bool:
        if part.isdigit():
            return len(part) < LEAST_RUN or bool(_TIME.match(part))
        tokens = len(encoding.encode_ordinary(part))
        return part.isalpha() and (tokens == 1 or len(part) >= ratio * tokens)

    return all(map(plain, filter(None, re.split(r"[-_/+=]", run))))


def _merged(taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans, sorted by start, as disjoint ranges."""
    out: list[tuple[int, int]] = []
    for a, _, b in taken:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the known forms, leftmost and not overlapping within a kind."""
    out = []
    lower = text.encode().lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, encoding, taken: list[tuple[int, int, int]], ratio: float = RANDOM_RATIO) -> list[tuple[int, int, int]]:
    """Runs, or what known forms leave of them, whose characters a token are below ``ratio``."""
    out = []
    ranges, k = _merged(taken), 0
    for m in _RUN.finditer(text):
        a, end = m.span()
        while k < len(ranges) and ranges[k][1] <= a:
            k += 1
        while a < end:  # runs and ranges are both in order: each is looked at once
            held = ranges[k] if k < len(ranges) and ranges[k][0] < end else (end, end)
            run = text[a : held[0]]
            if len(run) >= LEAST_RUN and len(run) < ratio * len(encoding.encode_ordinary(run)) and not _known(run, encoding, ratio):
                out.append((a, 3, held[0]))
            a = max(a, held[1])
            k += held[1] < end
    return out


def _line(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, path: str | None = None, ratio: float = RANDOM_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 (of the known forms' spans), spans (all, by start). No shuffle."""
    path = path or vocabulary_path("byte_bpe_50k.tiktoken")

    def make():
        encoding = _encoding(path)

        def one(i, text):
            text = text or ""
            base = base_spans(text)
            more = random_spans(text, encoding, base, ratio)
            n = [sum(k == x for _, k, _ in base) for x in range(3)]
            return i, *n, len(more), hashlib.sha256(_line(base).encode()).hexdigest(), _line(sorted([*base, *more]))

        return one

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact(text: str, spans: str, mask: str = "[SECRET]") -> str:
    """``text`` with every span of a ``spans`` string masked, overlapping ones as one."""
    out, end = [], 0
    for a, b in sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(",") if s)):
        if a >= end:
            out += [text[end:a], mask]
        end = max(end, b)
    return "".join([*out, text[end:]])
