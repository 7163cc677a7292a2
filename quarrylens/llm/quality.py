"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text, by language.

The model is of characters: a language's commonest, which cover ``COVER`` of its trusted text, and one class for all others, so
words never seen still have a probability. Counting: n-grams of all trusted documents, pre-summed in each task, then summed in shards by
n-gram; tables of neighbouring orders are joined on their shared n-gram for context totals, continuation counts and back-off masses.
Discounts come from the counts of counts.

Scoring: if the smoothed tables have ``MODEL_ROWS`` rows or fewer, which are counted, they are sent to the tasks and a document's n-grams
looked up; larger ones stay where they are and the documents' different n-grams are joined with them, order by order. Both give the same.

Trusted documents are those all of whose labels are of quality 1. They are dealt in halves by a hash of their ids, and each half has a model
too: it judges the other half, so that thresholds come from documents a model has not seen. A document is kept if its perplexity under
the model of all is at most its language's threshold, a quantile over that language's trusted documents.
Languages without trusted text, and null, use the model and threshold of all languages together.

Null or empty text has no perplexity and is not kept. Without any trusted document nothing can be judged, and all with text are kept. Repeated
ids: each row is judged by its own text. Null ids: judged, never trusted. Ids that are no numbers count as null. Empty tables give empty ones.
"""

from __future__ import annotations

import functools
import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import bounded_batches, cut, fresh, nearby

ORDER = 4
#: The share of a language's trusted text that its alphabet covers, and the most classes that an n-gram's number has room for.
COVER, MOST_CLASSES = 0.9995, 46_000
#: Rows of the smoothed tables that are sent to the tasks: 24 bytes each.
MODEL_ROWS = 6_000_000
QUANTILE = 0.99
ALL = "*"


#: Models by what they are fitted on: the first half of the trusted documents, the second, or all.
WHOLE = 2


def _name(part, lang):
    """The name of a model."""
    return F.concat(F.lit(part).cast("string") if isinstance(part, int) else part.cast("string"), F.lit(":"), lang)


def trusted(docs: DataFrame, labels: DataFrame, id_col: str, lang_col: str, text_col: str) -> DataFrame:
    """(half, lang, text) of all trusted documents with text."""
    ids = labels.groupBy(F.col("doc_id").cast("long").alias("trusted_id")).agg(F.min("quality").alias("q")).filter("q = 1 AND trusted_id IS NOT NULL")
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(lang_col, F.lit(ALL)).alias("lang"), F.col(text_col).alias("text")).filter("text <> ''")
    known = narrow.join(nearby(ids.select("trusted_id")), F.col("id") == F.col("trusted_id"), "left_semi")
    return known.select(F.pmod(F.xxhash64(F.lit("half"), F.col("id")), F.lit(2)).alias("half"), "lang", "text")


def _alphabets(text: DataFrame) -> dict[str, dict[str, int]]:
    """Class of each character by language, from 1 on: the commonest up to ``COVER`` of its text. All others have class 0."""
    counts = cut(text.select("lang", F.explode(F.split("text", "")).alias("c")).groupBy("lang", "c").count())
    both = counts.unionByName(counts.filter(F.col("lang") != ALL).withColumn("lang", F.lit(ALL))).groupBy("lang", "c").agg(F.sum("count").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "c")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("n").over(Window.partitionBy("lang"))
    top = both.withColumn("r", F.row_number().over(order)).withColumn("b", before).withColumn("w", whole).filter((F.col("b") < F.col("w") * COVER) & (F.col("r") < MOST_CLASSES))
    out: dict[str, dict[str, int]] = {}
    for row in top.collect():  # characters of a language
        out.setdefault(row["lang"], {})[row["c"]] = row["r"]
    return out


class Alphabet:
    """Classes of characters, and n-grams as numbers to the base of how many there are."""

    def __init__(self, classes: dict[str, int]):
        self.base = len(classes) + 1
        codes = {ord(c): r for c, r in classes.items() if len(c) == 1}
        self.table = np.zeros(max(codes, default=0) + 2, np.int64)  # the last is for all characters beyond
        for code, r in codes.items():
            self.table[code] = r

    def grams(self, text: str) -> np.ndarray:
        """The n-gram of order ORDER that ends at each character, after ORDER - 1 line ends."""
        codes = np.frombuffer(("\n" * (ORDER - 1) + text).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.table[np.minimum(codes, len(self.table) - 1)]
        n = len(symbols) - ORDER + 1
        out = symbols[:n].copy()
        for k in range(1, ORDER):
            out *= self.base
            out += symbols[k : k + n]
        return out


#: Characters whose n-grams a task holds at once: a few arrays of 8 bytes each.
AT_ONCE = 1 << 18


def _counted(texts, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of ``texts`` in order, and their counts; ``AT_ONCE`` characters at a time, so memory follows the different ones."""
    gram, c = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[np.ndarray] = []
    texts = [t for t in texts if t]
    for k, text in enumerate(texts):
        for at in range(0, len(text), AT_ONCE):
            # each piece after the first brings the characters before it, and leaves out the n-grams of those alone
            before = min(at, ORDER - 1)
            held.append(alphabet.grams(text[at - before : at + AT_ONCE])[before:])
            if sum(map(len, held)) >= AT_ONCE or (k + 1 == len(texts) and at + AT_ONCE >= len(text)):
                new, n = np.unique(np.concatenate(held), return_counts=True)
                gram, where = np.unique(np.concatenate([gram, new]), return_inverse=True)
                c = np.bincount(where, np.concatenate([c, n]), len(gram)).astype(np.int64)
                held = []
    return gram, c


def count_tables(text: DataFrame, alphabets: dict[str, Alphabet]) -> DataFrame:
    """(lang, gram, c): counts of the n-grams of order ORDER in every model: of each half and of both, a language's own and that of all."""

    def run(batches):
        for pdf in batches:
            for (half, lang), own in [*pdf.groupby(["half", "lang"]), *(((h, ALL), g) for h, g in pdf[pdf["lang"] != ALL].groupby("half"))]:
                gram, c = _counted(own["text"], alphabets[lang])
                yield pd.DataFrame({"lang": f"{half}:{lang}", "gram": gram, "c": c})

    halves = text.mapInPandas(run, "lang string, gram long, c long")
    names = F.array("lang", F.concat(F.lit(f"{WHOLE}:"), F.substring("lang", 3, 1 << 30)))
    return halves.select(F.explode(names).alias("lang"), "gram", "c").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _base(alphabets: dict[str, Alphabet]):
    sizes = F.create_map(*[F.lit(x) for lang, a in alphabets.items() for x in (lang, a.base)])
    return sizes[F.substring("lang", 3, 1 << 30)].cast("long")


def smoothed(counts: DataFrame, alphabets: dict[str, Alphabet]) -> DataFrame:
    """(lang, k, gram, p, gamma): for each order k, discounted probability of a seen n-gram and its context's back-off mass.

    Counts of the highest order are of occurrences, of lower ones of the different characters before (continuations). A row needs
    its context's total and its three kinds of successors: a join of an order's table with its sums by context, on the shard of
    the context.
    """
    out, table = None, cut(counts.withColumn("base", _base(alphabets)))
    for k in range(ORDER, 0, -1):
        held = table.withColumn("ctx", F.expr("gram div base"))
        of = held.groupBy("lang").agg(*[F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        # too few counts of counts give no estimate: half a count is taken off then
        d = [F.coalesce(F.when((F.col("n1") > 0) & (F.col(f"n{i}") > 0), F.greatest(F.lit(0.05), F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))), F.lit(0.5)).alias(f"d{i}") for i in (1, 2, 3)]
        discounts = of.select("lang", *d)
        sums = held.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), *[F.sum((F.col("c") == i).cast("long")).alias(f"m{i}") for i in (1, 2)], F.sum((F.col("c") >= 3).cast("long")).alias("m3"))
        rows = held.join(sums, ["lang", "ctx"]).join(F.broadcast(discounts), "lang")  # a row a language
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        mass = F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")
        rows = rows.select("lang", F.lit(k).alias("k"), "gram", (F.greatest(F.lit(0.0), F.col("c") - off) / F.col("total")).alias("p"), (mass / F.col("total")).alias("gamma"))
        out = rows if out is None else out.union(rows)
        if k > 1:  # different characters before each shorter n-gram
            shorter = F.expr(f"gram % ({' * '.join(['base'] * (k - 1))})").alias("gram")
            table = cut(table.select("lang", "base", shorter).groupBy("lang", "base", "gram").agg(F.count("*").alias("c")))
    return out


class Table:
    """A language's smoothed tables, each order interpolated with those below, down to the uniform."""

    def __init__(self, alphabet: Alphabet, orders: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.alphabet, self.base = alphabet, alphabet.base
        #: order: (seen n-grams in order, their log probabilities, their contexts in order, log back-off masses)
        self.orders: dict[int, tuple] = {}
        for k in range(1, ORDER + 1):
            gram, seen, gamma = orders.get(k, (np.zeros(0, np.int64), np.zeros(0), np.zeros(0)))
            p = seen + gamma * np.exp(self._log(k - 1, gram % self.base ** (k - 1)))
            ctx, first = np.unique(gram // self.base, return_index=True)
            self.orders[k] = gram, np.log(np.maximum(p, 1e-12)), ctx, np.log(np.maximum(gamma[first], 1e-12))

    def _log(self, k: int, grams: np.ndarray) -> np.ndarray:
        if k == 0:
            return np.full(len(grams), -math.log(self.base))
        seen, logs, ctx, off = self.orders[k]
        at, found = _found(seen, grams)
        out = np.empty(len(grams))
        out[found] = logs[at[found]]
        miss = grams[~found]
        if len(miss):
            at, known = _found(ctx, miss // self.base)
            back = np.zeros(len(miss))
            back[known] = off[at[known]]
            out[~found] = back + self._log(k - 1, miss % self.base ** (k - 1))
        return out

    def perplexity(self, text: str | None) -> float | None:
        if not text:
            return None
        gram, n = np.unique(self.alphabet.grams(text), return_counts=True)
        return math.exp(-float(self._log(ORDER, gram) @ n) / int(n.sum()))


def _found(among: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(among):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(among, wanted), len(among) - 1)
    return at, among[at] == wanted


@functools.lru_cache(maxsize=1)  # a worker goes on to other models, and would keep this one
def _tables(packed: bytes) -> dict[str, Table]:
    return {lang: Table(*parts) for lang, parts in pickle.loads(packed).items()}


class Model:
    """Fitted models: their alphabets, their smoothed rows, and, if they are few, one packed copy for the tasks."""

    def __init__(self, spark, alphabets: dict[str, Alphabet], rows: DataFrame | None, most_rows: int):
        self.alphabets, self.rows, self.packed = alphabets, rows, None
        self.names = sorted(r[0] for r in rows.select("lang").distinct().collect()) if alphabets else []
        if alphabets and rows.count() <= most_rows:
            held = rows.select("lang", F.col("k").cast("byte").alias("k"), "gram", F.col("p").cast("float").alias("p"), F.col("gamma").cast("float").alias("gamma")).toArrow()
            parts = {}
            for name in self.names:
                own = held.filter(pa.compute.equal(held["lang"], name)).drop_columns("lang").sort_by("gram")
                k = own["k"].to_numpy()
                parts[name] = alphabets[name[2:]], {n: tuple(own[c].to_numpy()[k == n] for c in ("gram", "p", "gamma")) for n in range(1, ORDER + 1)}
            del held, own, k
            pa.default_memory_pool().release_unused()  # else the driver keeps the room of all rows
            self.packed = spark.sparkContext.broadcast(pickle.dumps(parts, 5))

    def scored(self, docs: DataFrame, text_col: str, lang, into: str, part=WHOLE) -> DataFrame:
        """``docs`` with the perplexity of each row in the column ``into``; under the models of the half ``part``, where it has any."""
        bounded_batches(docs.sparkSession)
        if not self.names:
            return docs.withColumn(into, F.lit(None).cast("double"))
        lang = F.coalesce(lang, F.lit(ALL))
        tried = [_name(part, lang), _name(part, F.lit(ALL)), _name(WHOLE, lang)]
        name = F.coalesce(*[F.when(x.isin(self.names), x) for x in tried], F.lit(f"{WHOLE}:{ALL}"))
        if self.packed is None:
            return self._joined(docs, text_col, name, into)
        packed = self.packed

        @F.pandas_udf("double")
        def score(text: pd.Series, name: pd.Series) -> pd.Series:
            tables = _tables(packed.value)
            return pd.Series([tables[x].perplexity(t) for t, x in zip(text, name, strict=True)], dtype="float64")

        return docs.withColumn(into, score(F.col(text_col), name))

    def _joined(self, docs: DataFrame, text_col: str, name, into: str) -> DataFrame:
        """The same by joins: each text's different n-grams meet the table of each order, and their logarithms are summed by text."""
        alphabets = self.alphabets

        def split(batches):
            for pdf in batches:
                for th, lang, text in zip(pdf["th"], pdf["lang"], pdf["text"], strict=True):
                    gram, c = np.unique(alphabets[lang[2:]].grams(text), return_counts=True)
                    yield pd.DataFrame({"th": th, "lang": lang, "gram": gram, "c": c})

        texts = docs.select(F.xxhash64(text_col).alias("th"), name.alias("lang"), F.col(text_col).alias("text")).filter("text <> ''")
        grams = cut(texts.mapInPandas(split, "th long, lang string, gram long, c long").groupBy("th", "lang", "gram").agg(F.max("c").alias("c")))
        seen = grams.select("lang", "gram").distinct().withColumn("base", _base(alphabets)).withColumn("q", 1 / F.col("base"))
        for k in range(1, ORDER + 1):
            rows = self.rows.filter(F.col("k") == k).withColumn("base", _base(alphabets))
            off = rows.select("lang", F.expr("gram div base").alias("ctx"), "gamma").distinct()
            seen = seen.withColumn("own", F.expr(f"gram % ({' * '.join(['base'] * k)})")).withColumn("ctx", F.expr("own div base"))
            seen = seen.join(rows.select("lang", F.col("gram").alias("own"), "p"), ["lang", "own"], "left").join(off, ["lang", "ctx"], "left")
            q = F.when(F.col("p").isNotNull(), F.col("p") + F.col("gamma") * F.col("q")).otherwise(F.coalesce("gamma", F.lit(1.0)) * F.col("q"))
            seen = cut(seen.select("lang", "gram", "base", q.alias("q")))
        log = F.log(F.greatest("q", F.lit(1e-12)))
        sums = grams.join(seen, ["lang", "gram"]).groupBy("th", "lang").agg(F.exp(-F.sum(F.col("c") * log) / F.sum("c")).alias("perplexity"))
        th, of, p = fresh(docs, "th", "of", "p")
        sums = sums.toDF(th, of, p)
        same = (F.xxhash64(text_col) == F.col(th)) & (name == F.col(of))
        return docs.join(sums, same, "left").select(*docs.columns, F.col(p).alias(into))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = MODEL_ROWS) -> tuple[Model, DataFrame]:
    """The models, and (lang, perplexity) of all trusted documents under the models of the half they are not in."""
    bounded_batches(docs.sparkSession)
    known = trusted(docs, labels, id_col, lang_col, text_col)
    alphabets = {lang: Alphabet(classes) for lang, classes in sorted(_alphabets(known).items())}
    rows = cut(smoothed(count_tables(known, alphabets), alphabets)) if alphabets else None
    model = Model(docs.sparkSession, alphabets, rows, most_rows)
    unseen = model.scored(known, "text", F.col("lang"), "perplexity", 1 - F.col("half"))
    return model, cut(unseen.select("lang", "perplexity")).filter("perplexity IS NOT NULL")


def thresholds(unseen: DataFrame, quantile: float = QUANTILE) -> tuple[DataFrame, float | None]:
    """(lang, threshold): the quantile of a language's trusted documents' perplexities; and that of all languages.

    The quantile q can't be told from fewer than 1 / (1 - q) documents. A language with fewer has its median times the quantile, over all
    languages, of perplexities by their languages' medians.
    """
    at = lambda x, q: F.percentile_approx(x, q, 100_000)
    each = cut(unseen.groupBy("lang").agg(F.count("*").alias("n"), at("perplexity", quantile).alias("q"), at("perplexity", 0.5).alias("median")))  # a row a language
    pooled = unseen.join(each, "lang").agg(at("perplexity", quantile).alias("whole"), at(F.col("perplexity") / F.col("median"), quantile).alias("ratio")).first()
    few = F.col("n") * (1 - quantile) < 1 - 1e-9
    own = F.when(few, F.col("median") * F.lit(pooled["ratio"])).otherwise(F.col("q"))
    return each.filter(F.col("lang") != ALL).select("lang", own.alias("threshold")), pooled["whole"]


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, quantile: float, most_rows: int, names: list[str]) -> DataFrame:
    """``docs`` with the columns ``names``: perplexity, threshold and whether to keep the row."""
    perplexity, threshold, keep, own, other = names
    model, unseen = fit(docs, labels, id_col, text_col, lang_col, most_rows)
    limits, whole = thresholds(unseen, quantile)
    out = model.scored(docs, text_col, F.col(lang_col), perplexity)
    limits = nearby(limits.select(F.col("lang").alias(own), F.col("threshold").alias(other)))
    out = out.join(limits, F.col(lang_col) == F.col(own), "left")
    out = out.withColumn(threshold, F.coalesce(other, F.lit(whole).cast("double")))
    fine = F.col(perplexity) <= F.col(threshold) if model.names else F.length(text_col) > 0
    return out.withColumn(keep, F.coalesce(fine, F.lit(False))).drop(own, other)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, most_rows: int = MODEL_ROWS) -> DataFrame:
    """doc_id, lang, perplexity, threshold, keep (boolean) of each document."""
    names = fresh(docs, "perplexity", "threshold", "keep", "own", "other")
    out = _judged(docs, labels, id_col, text_col, lang_col, quantile, most_rows, names)
    return out.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), *[F.col(n).alias(c) for n, c in zip(names, ("perplexity", "threshold", "keep"), strict=False)])


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, most_rows: int = MODEL_ROWS) -> DataFrame:
    """The documents that ``classify`` keeps, all columns as they were; where the model is sent to the tasks, no text is shuffled."""
    names = fresh(docs, "perplexity", "threshold", "keep", "own", "other")
    out = _judged(docs, labels, id_col, text_col, lang_col, quantile, most_rows, names)
    return out.filter(F.col(names[2])).select(*docs.columns)
