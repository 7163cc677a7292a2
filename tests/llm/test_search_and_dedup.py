"""Top-k search, near duplicates, components and line dedup against brute force."""

import math
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import common, line_dedup, mtree, simhash
from quarrylens.llm.graphs import components

DOCS = "doc_id long, text string, size int, _th string, fingerprint string"  # extra columns, clashing names


def brute_top(rows, step, k):
    rows = list({(i, tuple(v)): (i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}.values())
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    out = set()
    for q, qv in ints:
        if q % step == 0:
            best = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ints if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("n", [0, 1, 4, 700])
def test_top_k_is_exact(spark, n, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD_BYTES", 200 * 64)
    monkeypatch.setattr(mtree, "BLOCK_BYTES", 20 * 64)
    rng = random.Random(n)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]) for i in range(n)]
    if n > 4:
        rows += [(7, None), (1000, []), (1010, [1.0, None]), (1020, [float("nan")] * 8), (1030, [float("inf")] * 8), (None, [1.0] * 8), rows[10], rows[20]]
        rows += [(2000 + i, [0.5] * 8) for i in range(160)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [tuple(r) for r in df.collect()]
    found = mtree.top_k(df, F.col("id") % 10 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in found.collect()} == brute_top(rows, 10, 5)


def test_tree_leaves_pages_unread():
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = np.floor(256 * (rng.normal(size=(4, 16))[rng.integers(0, 4, 4000)] + rng.normal(size=(4000, 16)) * 0.05))
    tree = mtree.MTree(np.arange(4000), vectors)
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                reads.append(len(key))
            return np.asarray(super().__getitem__(key))

    tree.vectors = vectors.view(Counted)
    tree.search(vectors[0], 0, 5)
    assert sum(reads) < 2500


def brute_fingerprint(text):
    data = bytearray((text or "").encode())
    for i, b in enumerate(data):
        if 65 <= b <= 90:
            data[i] = b + 32
    words = bytes(data).replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(fps):
        groups.setdefault(find(k), []).append(i)
    return sorted((i, f"{f:016x}", min(groups[find(k)])) for k, (i, f) in enumerate(fps))


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    rows = [(i, base[i % 40]) for i in range(100)]
    rows += [(200 + i, b + " tail" * (i % 3)) for i, b in enumerate(base)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "Ä É x y"), (304, "A B"), (305, "a b"), (306, "x " * 30000), (306, "x " * 30000)]
    rows += [(400 + i, t) for i, t in enumerate(" ".join(words[:30]).replace("w3 ", f"q{k} ") for k in range(20))]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], DOCS)
    found = sorted(tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect())
    assert found == brute_components(rows)


def test_every_pair_within_the_radius_is_linked(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for _ in range(3):
            fps.add(f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()
    label = {r["node"] & (1 << 64) - 1: r["root"] for r in got}
    for a in fps:
        for b in fps:
            if a != b and (a ^ b).bit_count() <= 2:
                assert label[a] == label[b]


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).columns == empty.columns


def test_similar_documents_are_dropped_once(spark):
    rng = random.Random(7)
    text = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(300)]
    near = [" ".join(text[:k] + ["edit"] + text[k + 1 :]) for k in (20, 150, 280)]
    other = [" ".join(rng.choice("klmnop") + str(rng.randrange(500)) for _ in range(300)) for _ in range(5)]
    rows = [(5, " ".join(text)), *((10 + i, t) for i, t in enumerate(near)), *((20 + i, t) for i, t in enumerate(other)), (20, other[0]), (40, None), (41, "")]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], DOCS)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [5, 20, 21, 22, 23, 24, 40]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


PASSAGE = ["Some shared line of a passage here", "then another one which is shared as well", "and the last of the three lines"]


def dedup(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], DOCS)
    out = line_dedup.dedup_lines(df, removed_col="gone")
    assert out.columns == [*df.columns, "gone"]
    return sorted(((r["doc_id"], r["text"], r["gone"]) for r in out.collect()), key=str)


def test_passages_go_but_for_the_first(spark):
    unique = [f"line {i} of its own kind" for i in range(40)]
    rows = [(i, "\n".join([unique[2 * i], *PASSAGE, unique[2 * i + 1]])) for i in range(10)]
    got = dedup(spark, rows)
    assert got[0] == (0, rows[0][1], 0)
    for i in range(1, 10):
        assert (i, f"{unique[2 * i]}\n{unique[2 * i + 1]}", 3) in got


def test_a_common_line_next_to_a_passage_shifts_nothing(spark):
    rows = [(i, "\n".join(["all rights reserved", *PASSAGE, f"own {i}"])) for i in range(4)] + [(50 + i, f"first {i}\nall rights reserved\nown too {i}") for i in range(6)]
    got = {i: t for i, t, _ in dedup(spark, rows)}
    assert all("another one" not in got[i] for i in range(1, 4))
    assert all(got[50 + i] == rows[4 + i][1] for i in range(6))  # a short line alone stays


def test_passages_go_wherever_boundaries_fall(spark):
    # 64 passages of two lines, 33 and 34 words; a boundary falls inside some of them
    line = lambda p, k, n: " ".join(f"p{p}l{k}w{j}" for j in range(n))
    passages = [f"{line(p, 0, 33)}\n{line(p, 1, 34)}" for p in range(64)]
    rows = [(100 * c + p, f"own {c} {p}\n{t}\nend {c} {p}") for c in range(2) for p, t in enumerate(passages)]
    rows += [(1000, "one\nfair use only\nall rights reserved\ntwo"), (1001, "three\nfair use only\nfour"), (1002, "five\nall rights reserved\nsix")]
    got = {i: (t, gone) for i, t, gone in dedup(spark, rows)}
    assert all(got[p] == (rows[p][1], 0) for p in range(64))
    assert all(got[100 + p] == (f"own 1 {p}\nend 1 {p}", 2) for p in range(64))
    assert all(got[i][1] == 0 for i in (1000, 1001, 1002))  # short lines stay


def test_long_single_lines_count_and_short_ones_do_not(spark):
    long = " ".join(f"word{i}" for i in range(55))
    got = dedup(spark, [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, "short\ne"), (4, "short\nf")])
    assert got == [(1, f"a\n{long}\nb", 0), (2, "c\nd", 1), (3, "short\ne", 0), (4, "short\nf", 0)]


def brute_lines(rows):
    """Chunks of a table by id, least words: what the rules of the module leave, in plain loops."""
    from quarrylens.llm.line_dedup import LEAST_WORDS, LONG_WORDS

    spark = SparkSession.getActiveSession()
    rows = list({(i, t): None for i, t in rows})
    ink = {key: [(p, x) for p, x in enumerate(key[1].split("\n")) if x.strip(" \t\n\v\f\r")] for key in rows}
    every = sorted({x for found in ink.values() for _, x in found})
    h = {x: spark.range(1).select(F.xxhash64(F.lit(x))).first()[0] for x in every}
    bound = {}
    n = Counter(x for found in ink.values() for _, x in found)
    chunks = set()
    for key, found in ink.items():
        for fine in (False, True):
            run = []
            for at, (_, x) in enumerate(found):
                if run and (run[-1] != at - 1 or _cuts(spark, bound, h[found[at - 1][1]], h[x]) or fine and n[found[at - 1][1]] != n[x]):
                    chunks.add((key, run[0], run[-1]))
                    run = []
                if n[x] > 1:
                    run.append(at)
            if run:
                chunks.add((key, run[0], run[-1]))
    text = {c: "\n".join(x for _, x in ink[c[0]][c[1] : c[2] + 1]) for c in chunks}
    words = {c: len(t.split()) for c, t in text.items()}
    place = lambda c: (c[0][0], spark.range(1).select(F.xxhash64(F.lit(c[0][1]))).first()[0], ink[c[0]][c[1]][0])
    seen = Counter(text.values())

    def going(some):
        out = set()
        for key in rows:
            own = sorted(c for c in some if c[0] == key)
            runs = []
            for c in own:
                if runs and c[1] <= max(x[2] for x in runs[-1]) + 1:
                    runs[-1].append(c)
                else:
                    runs.append([c])
            for run in runs:
                whole = sum(len(ink[key][k][1].split()) for k in range(run[0][1], max(x[2] for x in run) + 1))
                out |= {c for c in run if whole >= LONG_WORDS or words[c] >= LONG_WORDS or c[2] > c[1] and words[c] >= LEAST_WORDS}
        return out

    held = going({c for c in chunks if seen[text[c]] > 1})
    first = {}
    for c in held:
        first[text[c]] = min(first.get(text[c], place(c)), place(c))
    gone = going({c for c in held if place(c) != first[text[c]]})
    out = {}
    for key in rows:
        drop = {p for c in gone if c[0] == key for p in range(ink[key][c[1]][0], ink[key][c[2]][0] + 1)}
        out[key[0]] = "\n".join(x for p, x in enumerate(key[1].split("\n")) if p not in drop)
    return out


def _cuts(spark, known, a, b):
    if (a, b) not in known:
        known[a, b] = spark.range(1).select(F.pmod(F.xxhash64(F.lit(a), F.lit(b)), F.lit(line_dedup.BOUNDARY))).first()[0] == 0
    return known[a, b]


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(29)
    pool = [" ".join(f"p{k}w{j}" for j in range(rng.choice((1, 2, 8, 15, 30)))) for k in range(12)] + ["}", "", " ", "\r", "end\r"]
    rows = []
    for i in range(14):
        lines = []
        while len(lines) < 12:
            k = rng.randrange(len(pool))
            lines += rng.choice(([f"own {i} {len(lines)}"], pool[k : k + rng.randrange(1, 6)], [""]))
        rows.append((i, "\n".join(lines)))
    assert {i: t for i, t, _ in dedup(spark, rows)} == brute_lines(rows)


def test_blank_lines_and_short_lines_stay(spark):
    rows = [(1, "some text a\n\n\nsome text b"), (2, "other text a\n\n\nother text b"), (3, "if a:\n}\n}\nz1"), (4, "if b:\n}\n}\nz2"), (5, "one\r\n\r\n\r\ntwo"), (6, "three\r\n\r\n\r\nfour")]
    assert [(i, t) for i, t, gone in dedup(spark, rows) if not gone] == rows
    # a passage of paragraphs goes with the blank lines inside it, whatever their number; the breaks around it stay
    gap = lambda n: ("\n" * n).join(PASSAGE)
    got = dedup(spark, [(1, f"a\n\n{gap(2)}\n\nb"), (2, f"c\n\n{gap(3)}\n\nd")])
    assert got[1] == (2, "c\n\n\nd", 7)


def test_a_hot_line_is_counted_once_for_all(spark):
    rows = [(i, f"hot line\nown {i}") for i in range(400)]
    assert [(i, t) for i, t, _ in dedup(spark, rows)] == sorted(rows, key=str)


def test_line_dedup_edges(spark):
    text = "\n".join(PASSAGE)
    got = dedup(spark, [(None, text), (1, text), (1, text), (2, None), (3, ""), (4, "\n\n\n"), (5, "x\n" * 3000)])
    assert (None, text, 0) in got and got.count((1, "", 3)) == 2
    assert (2, None, 0) in got and (3, "", 0) in got
    assert dedup(spark, []) == []


def test_some_copy_of_every_line_stays(spark):
    rng = random.Random(11)
    pool = [f"pool line {i}" for i in range(30)]
    rows = [(i, "\n".join(pool[k : k + rng.randrange(1, 9)] if (k := rng.randrange(30)) < 25 else [f"own {i} {j}" for j in range(4)])) for i in range(80)]
    got = dedup(spark, rows)
    assert {x for _, t in rows for x in t.split("\n")} == {x for _, t, _ in got for x in t.split("\n") if x}


def shuffled(spark):
    """Bytes that each stage so far has written for shuffles, by its id."""
    gateway = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


@pytest.mark.parametrize("most", [common.PRINTED_KEYS, 0])
def test_texts_that_lose_no_line_are_not_shuffled(spark, monkeypatch, most):
    monkeypatch.setattr(common, "PRINTED_KEYS", most)
    rng = random.Random(5)
    own = [rng.randbytes(8000).hex() for _ in range(200)]
    rows = [(i, f"{t}\nits end" if i % 50 else "\n".join([t, *PASSAGE])) for i, t in enumerate(own)] + [(None, "its end"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()
    before = shuffled(spark)
    got = {tuple(r) for r in line_dedup.dedup_lines(df, removed_col="gone").collect()}
    assert got == {(i, own[i], 3) if i in (50, 100, 150) else (i, t, 0) for i, t in rows}
    written = sum(b for stage, b in shuffled(spark).items() if stage not in before)
    assert written < sum(map(len, own)) / 5 or not most  # four texts have the passage; without prints all go twice


@pytest.mark.parametrize("most", [common.PRINTED_KEYS, 0])
def test_rows_are_parted_by_keys_and_none_is_lost(spark, monkeypatch, most):
    monkeypatch.setattr(common, "PRINTED_KEYS", most)
    rows = spark.createDataFrame([(i, str(i), i, 1) for i in range(3000)] + [(None, "x", -1, 1), (None, "y", -2, 1), (5, None, -3, 1)], "id long, t string, shelf int, _prints int")
    keys = common.cut(rows.filter("id % 3 = 0 OR t IS NULL OR t = 'x'").select(F.col("id").alias("a"), F.col("t").alias("b")))
    some, none = (sorted(map(tuple, part.collect()), key=str) for part in common.parted(rows, ("id", "t"), keys, ("a", "b")))
    assert sorted(some + none, key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert not [r for r in none if r[1] is None or r[1] == "x" or r[0] is not None and r[0] % 3 == 0]
    assert len(some) < 1002 + 20 or not most
    empty = common.parted(rows, ("id", "t"), common.cut(keys.filter("a < 0")), ("a", "b"))
    assert [part.count() for part in empty] == [0, 3003] or not most


def test_line_dedup_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = line_dedup.dedup_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def shingle_set(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


@pytest.mark.parametrize("few", [1, 3, 32])
def test_similar_documents_are_those_of_the_similarity(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)  # larger groups go by blocks
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng = random.Random(13)
    common = [f"c{k}" for k in range(25)]  # a passage of many texts that are not similar
    texts = []
    for b in range(25):
        base = [f"t{b}x{rng.randrange(900)}" for _ in range(rng.randrange(30, 150))] + common * (b % 2)
        texts.append(base)
        for _ in range(5):
            edited = list(base)
            for _ in range(rng.randrange(1, 5)):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(10**6)}"
            texts.append(edited)
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                pairs += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert pairs > 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.similar_documents(df).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, found)) == [(i, find(i)) for i in range(len(rows))]


def test_a_pair_at_the_very_similarity_is_linked(spark):
    # sets of 66 and 60 shingles with 56 in common: 56 / 70
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(1, shared + "".join(f" a{k}" for k in range(10))), (2, shared + "".join(f" b{k}" for k in range(4))), (3, shared + "".join(f" c{k}" for k in range(11)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.similar_documents(df).select("doc_id", "component_id").collect())) == [(1, 1), (2, 1), (3, 3)]


def test_a_block_is_compared_in_little_memory():
    rng = np.random.default_rng(2)
    a, b = ([np.unique(rng.integers(0, 1 << 64, 2000, dtype=np.uint64)).view(np.int64) for _ in range(simhash.BLOCK)] for _ in range(2))
    b[5] = np.sort(np.concatenate([a[7][:1500], b[5][:500]]).view(np.uint64)).view(np.int64)
    tracemalloc.start()
    got = simhash._common(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[7, 5] == 1500 and got.sum() == 1500
    assert peak < 25e6


def test_blocks_give_links_enough():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    a, b = ([np.unique(rng.choice(pool, 60)).view(np.int64) for _ in range(n)] for n in (40, 50))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert simhash._common(a, b, columns=16, at_once=100).tolist() == want
    ok = rng.random((40, 50)) < 0.03
    label = lambda links: _roots(90, [(i, 40 + j) for i, j in links])
    assert label(simhash._spanning(ok)) == label(np.argwhere(ok).tolist())


def _roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def test_pairs_that_meet_among_many_are_linked(spark):
    shared = [f"s{k}" for k in range(60)]
    texts = [" ".join([*shared, *(f"o{i}x{k}" for k in range(30))]) for i in range(12)]  # all meet, none is similar
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, f"{t} edit") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    assert found == {i: i % 100 for i, _ in rows}


def test_rows_of_null_and_repeated_ids_are_kept_by_text(spark):
    text = [" ".join(f"{c}{k}" for k in range(80)) for c in "abcde"]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (7, text[2]), (7, text[3]), (8, text[3] + " edit"), (3, text[4]), (None, text[4])]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], DOCS)
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(df).collect()), key=str)
    assert kept == sorted([(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (3, text[4])], key=str)


def test_checkpoints_let_go_of_the_shuffles_before_them(spark, monkeypatch):
    for name in ("COLLECT_S", "COLLECT_APART", "_due"):
        monkeypatch.setattr(common, name, 0.0)
    held = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    df, before = spark.range(1000), held.size()
    for k in range(12):
        df = common.cut(df.groupBy((F.col("id") * 7 % (500 + k)).alias("id")).count().select("id"))
    for _ in range(50):  # the cleaner is a thread of its own
        if held.size() <= before + 4:
            break
        time.sleep(0.1)
    assert held.size() <= before + 4  # 12 were made; the last ones are still in use


def test_collections_are_apart(spark, monkeypatch):
    calls, now = [], [100.0]

    class Driver:
        class sparkContext:
            class _jvm:
                class System:
                    @staticmethod
                    def gc():
                        calls.append(now[0])
                        now[0] += 0.5

    monkeypatch.setattr(common, "_due", 0.0)
    monkeypatch.setattr(common.time, "monotonic", lambda: now[0])
    for _ in range(40):
        common.collected(Driver)
        now[0] += 1
    assert calls == [100.0, 115.5, 131.0]  # 30 times the 0.5 seconds that each took
