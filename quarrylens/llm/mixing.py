"""Mixing sources to target weights: hash-random order within a source, prefix sums, exact budgets, repeated epochs.

A document's key is the MD5 of a seed and its id (without one, its text), so its place in its source is random but the same in every run. Keys
are dealt into ranges (their first digits); sums of sizes by (source, range) are a small table whose running sums give each
range its offset, and a window within one (source, range) does the rest. No window spans a source, however many of
the rows it holds.

Null text: size 0. Null source: a source of its own, last in order. Equal keys (rows of one id): by size. An empty table
gives an empty one. Sources of size 0 get target 0, and every document of theirs is taken 0 times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import WORD, cut, fresh

#: No source is taken more often than this.
MOST_EPOCHS = 3
#: Hexadecimal digits of a key that make its range: 4,096 ranges a source.
RANGE_DIGITS = 3


def size_of(text):
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(by_source: DataFrame, weights=(1, 2, 3)) -> DataFrame:
    """(source, source_size) to (source, source_size, target): water-filled shares of all sizes by weight.

    Sources in order of ``3 * size / weight`` reach their limit first. The water line is what the limits of the sources
    before leave, by the weight of the rest: the first source whose limit is above its line is not limited, nor any after it.
    A row a source: one window over them all is small.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * MOST_EPOCHS
    line = Window.orderBy((cap / F.col("w")).asc(), "ord")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    after = line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.col("ord") - 1, F.lit(len(weights))) + 1).cast("int"))
    out = by_source.withColumn("ord", F.row_number().over(ordered)).withColumn("w", w.cast("long")).withColumn("total", F.sum("source_size").over(whole))
    out = out.withColumn("left", F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0))).withColumn("weight", F.sum("w").over(after))
    # limited: 3 * size <= w * left / weight, and so was every source before
    out = out.withColumn("free", F.max((cap * F.col("weight") > F.col("w") * F.col("left")).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    left, weight = F.max(F.when(F.col("free") == 1, F.col("left"))).over(whole), F.max(F.when(F.col("free") == 1, F.col("weight"))).over(whole)
    target = F.when(F.col("free") == 1, (F.col("w") * left).cast("double") / weight.cast("double")).otherwise(cap.cast("double"))
    return out.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=(1, 2, 3), seed: str = "mix", keep: tuple = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, and ``keep``: how many words of each document the mix takes.

    A source of size S and target T (whole words) gives T // S epochs of all its documents, then documents in key order up
    to exactly T: the one at the cut gives its first words only.
    """
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), key.alias("key"), *keep)
    sized = cut(sized.withColumn("part", F.substring("key", 1, RANGE_DIGITS)))
    sums = sized.groupBy("source", "part").agg(F.sum("size").alias("words"))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
    g, s = goal.alias("g"), sums.alias("s")
    ranges = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source"))).select(F.col("s.source").alias("r_source"), F.col("s.part").alias("r_part"), "offset", "source_size", "target")
    rows = sized.join(ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("part") == F.col("r_part")))
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *keep)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=(1, 2, 3), seed: str = "mix") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is taken, the one at the cut cut.

    Documents the mix takes no word of go. A document of size 0 has no word to take, and goes.
    """
    at, taken, size, turn = fresh(docs, "row", "taken", "size", "turn")
    # the row itself, not its id, says which text a decision is about: ids may repeat with other texts
    marked = docs.withColumn(at, F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)))
    plan = mix(marked, id_col, source_col, text_col, weights, seed, keep=(F.col(at),)).filter("taken > 0")
    # rows alike in all three share their words
    plan = plan.groupBy(at).agg(F.sum("taken").alias(taken), F.sum("size").alias(size), F.count("*").alias(turn))
    out = marked.join(plan, at)
    each, rest = F.floor(F.col(taken) / F.col(size)), F.col(taken) % F.col(size)
    out = out.withColumn(turn, F.explode(F.sequence(F.lit(1), (each + F.when(rest > 0, 1).otherwise(0)).cast("int"))))
    cut_text = _first_words(F.col(text_col), rest)
    text = F.when(F.col(turn) > each, cut_text).otherwise(F.col(text_col))
    return out.withColumn(text_col, text).select(*docs.columns)


def _first_words(text, n):
    """A text up to the end of its ``n``th word, as it stands."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1)), 1, n.cast("int")), "")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), text, '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS ord FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (ord - 1) % 3 AS BIGINT) AS w, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
l AS (SELECT *, total - CAST(coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / w, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
  CAST(sum(w) OVER (ORDER BY 3.0 * source_size / w, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight FROM w),
f AS (SELECT *, max(CASE WHEN 3 * source_size * weight > w * rest THEN 1 ELSE 0 END) OVER (ORDER BY 3.0 * source_size / w, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS free FROM l),
x AS (SELECT max(rest) AS rest, max(weight) AS weight FROM f WHERE free = 1),
t AS (SELECT source, source_size, CASE WHEN free = 1 THEN CAST(w * (SELECT rest FROM x) AS DOUBLE) / CAST((SELECT weight FROM x) AS DOUBLE) ELSE CAST(3 * source_size AS DOUBLE) END AS target FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
  CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) END AS BIGINT) AS taken FROM p
"""
