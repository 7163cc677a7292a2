"""Mixing, quality, main text and the pipeline against brute force, held-out labels and planted cases."""

import hashlib
import random
import re
import time
import tracemalloc
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylens.llm import html_extract, mixing, quality

DOCS = "doc_id long, text string, source string, size long, taken string, key string, part string"
SF = "/root/testdata/sf0.001"


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), Fraction(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = Fraction(3 * sizes[s])
            left -= target[s]
        free -= over
    return target


def mix_rows():
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randrange(1, 30)), "big") for i in range(150)]
    rows += [(200 + i, "a b c d\te\nf", "small") for i in range(5)]
    rows += [(300 + i, "x y z " * rng.randrange(1, 6), s) for i in range(40) for s in [rng.choice(["mid", "été", "zz"])]]
    rows += [(400, "only one here", None), (401, None, None), (402, None, "empty"), (403, "  ", "empty"), (200, "a b c d\te\nf", "small"), (500, "t " * 20000, "mid"), (None, "no id", "mid")]
    return rows


def test_mix_meets_targets(spark):
    rows = mix_rows()
    df = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], DOCS)
    out = mixing.mix(df)
    got = out.collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    targets = brute_targets(sizes)
    source = {(i, words(t)): s for i, t, s in rows}
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - float(targets[s])) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - targets[s]) < 1.5
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    df = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in mix_rows()], DOCS)
    plan = mixing.mix(df).agg(F.sum("taken")).first()[0]
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert out.agg(F.sum(mixing.size_of(F.col("text")))).first()[0] == plan
    whole = {r["doc_id"]: r["text"] for r in df.collect()}
    assert all(whole[r["doc_id"]].startswith(r["text"]) for r in out.collect())  # a cut text is its start as it stands


def test_rows_without_ids_are_dealt_by_text(spark):
    df = spark.createDataFrame([(None, f"w{i} x", "a", 1, "x", "y", "z") for i in range(300)], DOCS)
    key = mixing.mix(df.withColumn("source", F.col("doc_id").cast("string")))
    assert key.count() == 300 and key.agg(F.sum("taken")).first()[0] == 600


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    out = quality.classify(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r["quality"], r["keep"]): r["count"] for r in out}
    assert n.get((1, False), 0) <= 0.02 * n[1, True]
    assert n[0, False] >= 0.7 * (n[0, False] + n.get((0, True), 0))


def test_quality_edges(spark):
    good = [(i, f"the good text number {i} is a plain sentence about things and more things.", "en", "x") for i in range(30)]
    rows = [*good, (100, None, "en", "x"), (101, "", "en", "x"), (102, "%%%### $$$ @@@ !!! %%% ###", "en", "x"), (103, good[3][1], None, "x"), (104, good[4][1], "xx", "x"), (None, good[5][1], "en", "x"), (0, good[0][1], "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, keep string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(102, 0, 0), (None, 1, 0), (3, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    keep = {r["doc_id"]: r["keep"] for r in out}
    assert len(out) == len(rows) and all(keep[i] for i in range(30))
    assert (keep[100], keep[101], keep[102], keep[103], keep[104], keep[None]) == (False, False, False, True, True, True)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 34
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r["keep"] for r in quality.classify(docs.filter("doc_id < 5"), labels.limit(0)).collect()} == {True}


def brute_kneser_ney(symbols, size):
    """Interpolated modified Kneser-Ney of one sequence, straight from its definition."""
    counts = {quality.ORDER: {}}
    for i in range(len(symbols) - quality.ORDER + 1):
        g = tuple(symbols[i : i + quality.ORDER])
        counts[quality.ORDER][g] = counts[quality.ORDER].get(g, 0) + 1
    for k in range(quality.ORDER - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1

    def p(g, k):
        if k == 0:
            return 1 / size
        table = counts[k]
        n = [sum(c == i for c in table.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else None
        d = [0.0] + [max(0.05, i - (i + 1) * y * n[i + 1] / n[i]) if n[1] and n[i] else 0.5 for i in (1, 2, 3)]
        row = {h: c for h, c in table.items() if h[:-1] == g[:-1]}
        if not row:
            return p(g[1:], k - 1)
        total = sum(row.values())
        c = row.get(g, 0)
        return max(0.0, c - d[min(c, 3)]) / total + sum(d[min(x, 3)] for x in row.values()) / total * p(g[1:], k - 1)

    return lambda g: p(tuple(g), quality.ORDER)


def test_counting_holds_a_part_of_the_texts_at_once():
    rng = random.Random(3)
    alphabet = quality.Alphabet({c: i for i, c in enumerate("abcdefgh ", 1)})
    texts = ["".join(rng.choices("abcdefgh x", k=n)) for n in (2_000_000, 1, 3, 700_000, quality.AT_ONCE, *[3000] * 300)]
    want = np.unique(np.concatenate([alphabet.grams(t) for t in texts]), return_counts=True)
    tracemalloc.start()
    got = quality._counted([None, "", *texts, ""], alphabet)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((g == w).all() and len(g) == len(w) for g, w in zip(got, want, strict=True))
    assert peak < 30e6  # the n-grams of all texts are 29 MB, in each of several arrays
    assert [len(x) for x in quality._counted([], alphabet)] == [0, 0]


def test_model_is_kneser_ney(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcd ") for _ in range(300))
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model, _ = quality.fit(docs, labels)
    table = quality._tables(model.packed.value)["2:en"]
    size = table.base
    first = table.alphabet.grams(text)
    symbols = [0] * (quality.ORDER - 1) + (first % size).tolist()
    assert first[0] == symbols[quality.ORDER - 1]  # line ends are no class of this text
    exact = brute_kneser_ney(symbols, size)
    for _ in range(60):
        g = [rng.randrange(size) if rng.random() < 0.2 else rng.choice(symbols) for _ in range(quality.ORDER)]
        code = 0
        for x in g:
            code = code * size + x
        assert np.exp(table._log(quality.ORDER, np.array([code])))[0] == pytest.approx(exact(g), rel=1e-4)
    whole = table._log(quality.ORDER, np.arange(50 * size)).reshape(-1, size)
    assert np.exp(whole).sum(1) == pytest.approx(np.ones(50), rel=1e-3)
    logs = [np.log(exact(symbols[i : i + quality.ORDER])) for i in range(len(symbols) - quality.ORDER + 1)]
    assert table.perplexity(text) == pytest.approx(np.exp(-np.mean(logs)), rel=1e-4)


def test_scores_by_joins_are_those_by_lookup(spark):
    rng = random.Random(2)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randrange(1, 9)))
    kinds = {"en": "abcdefg", "zh": "".join(map(chr, range(0x4E00, 0x4E00 + 200))), None: "äöüxyz\U0001f600", "xx": "a!b"}
    rows = [(i, " ".join(word(kinds[k]) for _ in range(rng.randrange(1, 40))), k) for i in range(80) for k in [rng.choice(list(kinds))]]
    rows += [(200, None, "en"), (201, "", "zh"), (202, rows[0][1], rows[0][2]), (203, "\U0001f600 " * 3000, "en")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, tid long, _th long, perplexity long")
    labels = spark.createDataFrame([(i, int(r[2] != "xx"), 0) for i, r in enumerate(rows[:80])], "doc_id long, quality int, toxic int")
    a, b = ({r["doc_id"]: r for r in quality.classify(docs, labels, most_rows=n).collect()} for n in (10**6, 0))
    assert len(a) == len(b) == len(rows)
    for i, r in a.items():
        assert r["keep"] == b[i]["keep"] and r["threshold"] == pytest.approx(b[i]["threshold"], rel=1e-4)
        assert (r["perplexity"] is None) == (b[i]["perplexity"] is None) == (i in (200, 201))
        assert r["perplexity"] is None or r["perplexity"] == pytest.approx(b[i]["perplexity"], rel=1e-4)
    kept = quality.keep_good(docs, labels, most_rows=0)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in a.items() if r["keep"]}


def test_thresholds_are_quantiles_of_unseen_trusted_text(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    _, unseen = quality.fit(docs, labels)
    limits, whole = quality.thresholds(unseen, 0.9)
    limits, rows = {r["lang"]: r["threshold"] for r in limits.collect()}, unseen.toPandas()
    quantile = lambda p: np.sort(p)[int(np.ceil(0.9 * len(p))) - 1]
    assert whole == pytest.approx(quantile(rows["perplexity"]))
    for lang, g in rows.groupby("lang"):
        assert limits[lang] == pytest.approx(quantile(g["perplexity"])) or len(g) < 10
    out = quality.classify(docs, labels, quantile=0.9).collect()
    assert all(r["threshold"] == limits.get(r["lang"], whole) and r["keep"] == (r["perplexity"] is not None and r["perplexity"] <= r["threshold"]) for r in out)


PAGE = """<!DOCTYPE html><html><head><title>Site &amp; more</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- <p>comment</p> --><div class="ad-slot">Buy now this thing, it is really cheap today and only today</div>
<article><h1>The&nbsp;Title</h1><p>First   paragraph with <b>bold</b> text<br>and a break.<p>Unclosed &lt;one&gt;, see <a href="x">this link</a>.<aside>Related: many other things to be read</aside><form><label>Mail</label><input><button>Go</button></form>
<div class="cookie-notice">We use cookies, as everyone does these days</div><ul><li>item one<li>item two</ul><section id="comments"><p>A reader says that it is very nice and writes a lot of words about it</section></article>
<footer>&copy; 2024 the site and its owners, all rights reserved</footer></body></html>"""


def test_main_text(spark):
    want = "The Title\nFirst paragraph with bold text and a break.\nUnclosed <one>, see this link.\nitem one\nitem two"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>"), (5, "u", PAGE), (6, "u", "<article>" + "<p>word</p>" * 5000 + "</article>"), (7, "u", "<nav>only <a href=x>menu</a></nav>")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(df).collect()}
    assert got[1] == (want, len(want)) == got[5]
    assert got[2] == got[3] == got[4] == got[7] == ("", 0)
    assert got[6][0] == "\n".join(["word"] * 5000)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_tree_on_pages_without_article():
    text = "This is a long paragraph of main text that goes on and on, so that it has enough words to be told from the rest of the page."
    page = f"<div><a href=1>One</a> <a href=2>Two</a></div><p>{text}</p><p>{text}</p><div><a href=3>Next page</a></div>"
    assert html_extract.main_text(page) == f"{text}\n{text}"
    inside = f'<div class="with-sidebar"><p>{text}</p><div class="sideBar"><p>{text}</p></div><div id="user_comments"><p>{text}</p></div></div>'
    assert html_extract.main_text(inside) == text


def test_odd_pages_are_read_once():
    """Shapes that make a search from each tag quadratic: 300 kB each, within seconds."""
    n = 30_000
    shapes = ["<a " * n, "<div>" * n + "</b>" * n, "<b>" * n + "<div>" * n + "</b>" * n, "<b>" * n + "<p>x" * n, '<a "' * n, "<a '\"" * n, "<!--" * n, "<!" * n, "<script>" * n, "&" * n, "<nav>" * n + "<article>x" * n]
    began = time.process_time()
    for page in shapes:
        html_extract.main_text(page)
    assert time.process_time() - began < 30
    assert html_extract.main_text("<article><p>five words of plain text <a title='x>y'>and a link</a> a < b <i>c") == "five words of plain text and a link a < b c"
    assert html_extract.main_text("<p>some words of the text stand here <b title=\"open>bold</b> and go on to the end") == "some words of the text stand here bold and go on to the end"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Each stage's input and output as lists, over the smallest tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def test_pipeline_stages(staged):
    columns = staged[0][0].columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing", "BPE"]
    assert all(after.columns == columns for _, after in staged[:-1])
    texts = [{(r["doc_id"], r["text"]) for r in after.collect()} for _, after in staged[:-1]]
    before = {(r["doc_id"], r["text"]) for r in staged[0][0].collect()}
    assert texts[0] < before
    assert {i for i, _ in texts[1]} == {i for i, _ in texts[0]} and texts[1] != texts[0]
    assert texts[2] < texts[1]
    ids = {i for i, _ in texts[2]}
    assert {i for i, _ in texts[3]} <= ids
    copies = {}
    for i, t in sorted(texts[1]):
        copies.setdefault(t, []).append(i)
    for group in copies.values():  # of equal texts one at most stays
        assert len(ids & set(group)) <= 1


def test_pipeline_tokens(staged):
    from quarrylens.llm import bpe

    docs, out = staged[-1]
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary_path("word_bpe_49k.json"))
    want = sorted((r["doc_id"], hashlib.sha256(np.array(library.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in docs.collect())
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in out.collect()) == want


def test_pipeline_run_is_its_stages(spark, staged):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, staged[-1][1].collect()))
