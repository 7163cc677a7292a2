"""SimHash near-duplicates: fingerprints of word shingles, linked at few differing bits by meet-in-the-middle balls.

Each distinct fingerprint emits every value within half the radius of it. Two fingerprints within the radius have such a value in
common, and all that meet at one value are within the radius of each other, so linking each to the least one there links them
all: no pairs within a group. A value has at most as many fingerprints as its own ball has values (65 at radius 2).
Found links are checked again by their differing bits.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import bounded_batches, cut, fresh, map_rows, nearby, stored
from quarrylens.llm.graphs import components

SEED = 42
RADIUS = 2


def _hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the ``width``-word shingles, repeats included; of a shorter text, the hash of all its words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.array([], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) > width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of the ``width``-word shingles, repeats included. No words (or null): 0."""
    return _majority(_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """(id, fp long) of each row; ``width`` words a shingle."""

    def make():
        return lambda i, text: (i, fingerprint(text, width))

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, fp long")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) of different fingerprints (column fp) at ``radius`` or fewer bits, enough to connect all such."""
    half = (radius + 1) // 2
    masks = [sum(1 << b for b in bits) for n in range(half + 1) for bits in itertools.combinations(range(64), n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    near = distinct.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value"))
    least = F.min("fp").over(Window.partitionBy("value"))
    pairs = near.select(least.alias("a"), F.col("fp").alias("b")).filter("a <> b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the least doc_id that links reach.

    A row for each row of ``docs``. Null and blank texts have fingerprint 0, linked like any other. A null id is left out of
    the least; a component of null ids only has a null id. An empty table gives an empty one. An odd radius raises ValueError.
    """
    if radius % 2:
        raise ValueError("the radius is even: two halves meet")
    marked = cut(fingerprints(docs, id_col, text_col, width=width))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    classes = cut(classes)
    linked = components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    # where no link is, a fingerprint is its own component
    rooted = classes.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(firsts, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Groups of so many rows at most are compared as pairs of rows; larger ones in blocks of so many rows, by matrix products.
FEW, BLOCK = 32, 256


def _share(similarity: float) -> float:
    """The share of all shingles, those of least hash, that documents are first compared on: more than two similar sets can differ in."""
    return min(1.0, (1 - similarity) * 5 / 3)


def _sketches(docs: DataFrame, id_col: str, text_col: str, similarity: float, width: int) -> DataFrame:
    """(node, doc_id, th, key, fp, n, sample): of each row the number of distinct shingles, those of least hash, and a hash of them all; node: a number of the row."""
    import xxhash

    least = np.uint64(min((1 << 64) - 1, int(_share(similarity) * (1 << 64))))

    def make():
        def one(i, th, text):
            hashes = _hashes(text, width)
            distinct = np.unique(hashes)
            key = xxhash.xxh64_intdigest(distinct.tobytes(), SEED)
            return i, th, key - (key >> 63 << 64), _majority(hashes), len(distinct), distinct[: np.searchsorted(distinct, least, "right")].view(np.int64)

        return one

    text = F.col(text_col)
    found = map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")), make, "doc_id long, th long, key long, fp long, n int, sample array<long>")
    return stored(found.withColumn("node", F.monotonically_increasing_id()), "sketches")


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, shingles): all distinct shingle hashes of the rows that ``nodes`` (node, doc_id, th) names."""

    def make():
        return lambda node, text: (node, np.unique(_hashes(text, width)).view(np.int64))

    wanted = nearby(nodes.select("node", F.col("doc_id").alias("i"), F.col("th").alias("h")))
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    text = text.join(wanted, (F.col("th") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("i"))).select("node", "text")
    # of rows alike in id and text, one
    return stored(map_rows(text, make, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles")), "shingle-sets")


def _shared(tokens: DataFrame) -> DataFrame:
    """(token, node, df): the rows whose token more than one row has."""
    # from a checkpoint, the counts bring no partitioning of their own: a hot token's share of the join can be split
    often = cut(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"))
    return tokens.join(often, "token")


def _most_shared(n, similarity: float):
    """How many shingles a set of ``n`` has in common with any similar one, at least."""
    return F.ceil(n * F.lit(similarity) - 1e-9)


def _hopeful(table: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(all nodes, those that can have a similar one): a row for each distinct set.

    Of a set's n shingles at most (1 - similarity) n are missing in a similar one. So of its m sampled shingles all but so many
    are in another's sample as well; most documents have far fewer.
    """
    first = F.min(F.struct("node", "fp", "n", "doc_id", "th", F.size("sample").alias("m")))
    nodes = cut(table.groupBy("key").agg(first.alias("x")).select("key", "x.*"))
    copies = nearby(table.select("node").join(nodes.select("node"), "node", "left_anti"))
    tokens = table.select("node", "sample").join(copies, "node", "left_anti").select("node", F.explode("sample").alias("token"))
    held = _shared(tokens).groupBy("node").agg(F.count("*").alias("held"))
    least = F.col("m") - (F.col("n") - _most_shared(F.col("n"), similarity))
    return nodes, cut(nodes.filter("n > 0").join(held, "node", "left").filter(F.coalesce("held", F.lit(0)) >= least).drop("key", "held", "m"))


def _prefixes(sets: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, fp, n, prefix): of the nodes most of whose shingles are shared, the shared ones among the first that a similar set can't all lack.

    Shingles are ordered from rare to frequent, so what many documents have stands last and seldom is in a prefix.
    """
    tokens = _shared(sets.select("node", F.explode("shingles").alias("token")))
    ranked = tokens.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    spare = F.size("ranked") - _most_shared(F.col("n"), similarity)
    rows = ranked.join(nodes.select("node", "fp", "n"), "node").filter(spare >= 0)
    return cut(rows.select("node", "fp", "n", F.slice(F.col("ranked.token"), 1, (spare + 1).cast("int")).alias("prefix")))


def _sized(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, n_a, n_b, ...) of pairs whose sizes allow the similarity."""
    for x in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}")), x)
    return pairs.filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similarity - 1e-9)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of (a, b, n_a, n_b) the (a, b) whose shingle sets have a Jaccard index of ``similarity`` or more."""
    pairs = cut(pairs)
    for x in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")), x)
    both = F.size(F.array_intersect("set_a", "set_b"))
    return cut(pairs.filter(both * (1 + similarity) >= (F.col("n_a") + F.col("n_b")) * similarity - 1e-9).select("a", "b"))


def _stars(prefixes: DataFrame, similarity: float) -> DataFrame:
    """(a, b) to try first: fingerprints at few bits, and each node with the least and the greatest at each prefix shingle. No pairs within a group."""
    firsts = cut(prefixes.groupBy("fp").agg(F.min("node").alias("first")))
    near = links(firsts.select("fp"))
    for x in "ab":
        near = near.join(firsts.select(F.col("fp").alias(x), F.col("first").alias(f"of_{x}")), x)
    alike = prefixes.join(firsts, "fp").select("node", "first")
    tokens = prefixes.select("node", F.explode("prefix").alias("token"))
    ends = cut(tokens.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high"))
    stars = tokens.join(ends, "token").select("node", F.explode(F.array("low", "high")).alias("end"))
    pairs = near.select("of_a", "of_b").union(alike).union(stars).toDF("a", "b").filter("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _sized(pairs, prefixes, similarity)


def _spanning(ok: np.ndarray) -> list[tuple[int, int]]:
    """Row and column of links enough to connect what the true cells connect: fewer than there are rows and columns."""
    out: list[tuple[int, int]] = []
    left, right = np.ones(ok.shape[0], bool), np.ones(ok.shape[1], bool)
    for start in range(ok.shape[0]):
        todo = [start] if left[start] else []
        left[start] = False
        while todo:
            i = todo.pop()
            for j in np.nonzero(ok[i] & right)[0].tolist():
                right[j] = False
                out.append((i, j))
                more = np.nonzero(ok[:, j] & left)[0].tolist()
                left[more] = False
                out += [(k, j) for k in more]
                todo += more
    return out


def _common(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096, at_once: int = 1 << 17) -> np.ndarray:
    """Sizes of the intersections of each sorted set of ``a`` with each of ``b``, by matrix products over some shingles at a time."""
    sets = [x.view(np.uint64) for x in (*a, *b)]
    out = np.zeros((len(a), len(b)), np.float32)
    ranges = -(-sum(map(len, sets)) // at_once)
    for part in range(ranges):  # a range of hashes at a time bounds what is copied
        low, high = (np.uint64(min((1 << 64) - 1, k * ((1 << 64) // ranges))) for k in (part, part + 1))
        cuts = [x[np.searchsorted(x, low) : len(x) if part + 1 == ranges else np.searchsorted(x, high)] for x in sets]
        row = np.repeat(np.arange(len(sets)), [len(x) for x in cuts])
        token = np.unique(np.concatenate(cuts), return_inverse=True)[1]
        order = np.argsort(token, kind="stable")
        row, token = row[order], token[order]
        for at in range(0, int(token[-1]) + 1 if len(token) else 0, columns):
            x, y = np.searchsorted(token, (at, at + columns))
            cells = np.zeros((len(sets), columns), np.float32)
            cells[row[x:y], token[x:y] - at] = 1
            out += cells[: len(a)] @ cells[len(a) :].T
    return out


def _crowded(groups: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): verified links between different components in groups (token, node, root) of any size.

    All members but those of a group's largest component meet all members, a block of each at a time. A block gives no more
    links than it has rows, enough to connect what it connects. ``sizes``: token, members, others (than the largest component's), top.
    """

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")  # the same links in every attempt
        a, b = part[part["side"] == 0], part[part["side"] == 1]
        if a.empty or b.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        x, y = list(a["shingles"]), list(b["shingles"])
        n = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
        ok = (_common(x, y).astype(float) * (1 + similarity) >= n * similarity - 1e-9) & (a["root"].to_numpy()[:, None] != b["root"].to_numpy()[None, :])
        found = _spanning(ok)
        return pd.DataFrame({"a": a["node"].to_numpy()[[i for i, _ in found]], "b": b["node"].to_numpy()[[j for _, j in found]]}, dtype="int64")

    many = sizes.select("token", "top", F.ceil(F.col("members") / BLOCK).alias("across"), F.ceil(F.col("others") / BLOCK).alias("down"))
    rows = groups.join(many, "token")
    own = F.xxhash64("node")
    other = rows.filter("root <> top").select("token", "node", "root", F.lit(0).alias("side"), F.pmod(own, "down").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)).alias("j"))
    every = rows.select("token", "node", "root", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("down") - 1)).alias("i"), F.pmod(own, "across").alias("j"))
    bounded_batches(sets.sparkSession)
    return other.union(every).join(sets, "node").groupBy("token", "i", "j").applyInPandas(compare, "a long, b long")


def _met(prefixes: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): verified links between all nodes of different components that share a prefix shingle."""
    rooted = prefixes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.explode("prefix").alias("token"))
    rooted = cut(rooted)
    parts = rooted.groupBy("token", "root").agg(F.count("*").alias("c"))
    sizes = parts.groupBy("token").agg(F.sum("c").alias("members"), F.max(F.struct("c", "root")).alias("top"))
    sizes = cut(sizes.select("token", "members", (F.col("members") - F.col("top.c")).alias("others"), F.col("top.root").alias("top")).filter("others > 0"))
    few = rooted.join(sizes.filter(F.col("members") <= FEW).select("token"), "token")
    pairs = few.toDF("token", "a", "root_a").join(few.toDF("token", "b", "root_b"), "token").filter("a < b AND root_a <> root_b").groupBy("a", "b").agg(F.count("*").alias("met"))
    # all that two sets have in common: their common prefix shingles, and no more than one of the two has behind its prefix
    behind = F.greatest(_most_shared(F.col("n_a"), similarity), _most_shared(F.col("n_b"), similarity)) - 1
    pairs = _sized(pairs, prefixes, similarity).filter((F.col("met") + behind) * (1 + similarity) >= (F.col("n_a") + F.col("n_b")) * similarity - 1e-9)
    return _verified(pairs, sets, similarity).union(_crowded(rooted, sizes.filter(F.col("members") > FEW), sets, similarity))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = 5) -> DataFrame:
    """doc_id, component_id (least doc_id reached), text_hash, component; links are the pairs whose sets of ``width``-word shingles have a Jaccard index of ``similarity`` or more.

    1. Two filters, on a share of all shingles and then on all, leave the documents most of whose shingles others have too: no other can have
       a similar one. 2. SimHash links at few bits, and links to the least and the greatest node at each prefix shingle, join most copies
       without any pairs within a group. 3. All pairs that share a prefix shingle but no component yet are compared (a prefix filter: no pair of
       the similarity is missed). Each link is verified by the sets themselves.

    Shingles are told apart by their 64-bit hashes. A text of fewer words is one shingle; texts without words, and null, are one component.
    A row for each row; null ids are left out of the least. An empty table gives an empty one.
    """
    table = _sketches(docs, id_col, text_col, similarity, width)
    nodes, hopeful = _hopeful(table, similarity)
    sets = _sets(docs, hopeful, id_col, text_col, width)
    prefixes = _prefixes(sets, hopeful, similarity)
    first = _verified(_stars(prefixes, similarity), sets, similarity)
    linked = components(first.union(_met(prefixes, components(first), sets, similarity)))
    rooted = nodes.select("key", "node").join(linked, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    marked = table.select("doc_id", "th", "key").join(cut(rooted), "key")
    marked = cut(marked.select("doc_id", F.col("th").alias("text_hash"), F.col("root").alias("component")))
    named = cut(marked.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return marked.join(named, "component").select("doc_id", "component_id", "text_hash", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = 5) -> DataFrame:
    """``docs`` with one row of each component of ``similar_documents``: that of its least id (null last), and of equal ids that of the least text hash.

    Rows that stay don't move: those to drop are looked up, and only rows alike in id and text are dealt by them to keep one.
    """
    found = similar_documents(docs, id_col, text_col, similarity, width)
    the_id, the_hash, turn = fresh(docs, "id", "hash", "turn")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    kept = cut(found.groupBy("component").agg(least.alias("k")).select(F.col("k.doc_id").alias("i"), F.col("k.text_hash").alias("h")))
    rows = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("c"))
    rows = rows.join(kept.withColumn("stays", F.lit(True)), (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("i")), "left")
    marks = nearby(rows.filter("stays IS NULL OR c > 1").select(F.col("doc_id").alias(the_id), F.col("text_hash").alias(the_hash), (F.col("stays") & (F.col("c") > 1)).alias(turn)))
    same = (F.xxhash64(text_col) == F.col(the_hash)) & F.col(id_col).cast("long").eqNullSafe(F.col(the_id))
    order = Window.partitionBy(the_id, the_hash).orderBy(F.lit(1))
    again = docs.join(marks.filter(F.col(turn)), same).withColumn(turn, F.row_number().over(order)).filter(F.col(turn) == 1)
    return docs.join(marks, same, "left_anti").union(again.select(*docs.columns))
