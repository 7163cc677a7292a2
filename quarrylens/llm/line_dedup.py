"""Line dedup by content-defined chunks of repeated lines, in DataFrame functions only.

1. Every line but blank ones is hashed; lines that occur once anywhere fall out, so what is left of a document are runs of repeated lines.
2. A rolling hash over neighbouring line hashes cuts a run into chunks where it is 0 modulo ``BOUNDARY``: what precedes a
   passage shifts no boundary inside it. A second, finer cut is made as well where the lines' global counts change, so a passage next
   to a common line is a chunk of its own.
3. Chunks of several lines and ``LEAST_WORDS`` words, or of ``LONG_WORDS`` words, whose hash repeats are candidates; so is a lighter chunk
   if it and the repeated chunks that adjoin it have ``LONG_WORDS`` words. Their bytes are fetched and grouped by the bytes themselves,
   so only equal text is ever removed. The first place of each (least id, then position) stays, and adjoining words are counted again.

Blank lines (of white space) weigh nothing, make no chunk and part no run: those inside a chunk that goes go with it, all others stay.
Short lines that recur, such as closing brackets, therefore stay unless they stand in a passage.
Each removed chunk has an equal one at an earlier place, so some copy of every line stays.
Rows with one id and one text are one document. Null text stays null; empty text is one empty line and stays. A null id
is first in order. A document whose lines all go keeps its row with an empty text. Lines end at \\n only: a \\r before it is part of the line.
An empty table gives an empty one. Texts are not bounded in length; a document's repeated lines are sorted together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import WORD, cut, fresh, parted, stored

#: A boundary falls after a line by this chance: chunks have so many lines on average.
BOUNDARY = 16
#: Words that make a passage of whatever lines, and those that make one of several lines in one chunk.
LONG_WORDS, LEAST_WORDS = 50, 20
#: What a line has that isn't blank.
INK = r"[^\x20\x09-\x0D]"


def _lines(text):
    return F.split(text, "\n", -1)


def _repeated_lines(marked: DataFrame) -> DataFrame:
    """(id, th, at, pos, h, words, n): lines whose hash occurs more than once, with its count; at: place among the lines that aren't blank."""
    numbered = F.transform(_lines(F.col("text")), lambda line, pos: F.struct(pos.alias("pos"), line.alias("line")))
    inked = F.filter(numbered, lambda x: x["line"].rlike(INK))
    lines = marked.select("id", "th", F.posexplode(inked).alias("at", "x"))
    lines = lines.select("id", "th", "at", "x.pos", F.xxhash64("x.line").alias("h"), F.regexp_count("x.line", F.lit(WORD)).alias("words"))
    # from a checkpoint, the counts bring no partitioning of their own: a hot line's share of the join can be split
    counts = cut(lines.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    return lines.join(counts, "h")


def _chunks(lines: DataFrame, boundary: int, long_words: int, least_words: int) -> DataFrame:
    """(id, th, a, b, fa, fb, wa, wb, alone, hash): first and last line of each chunk, their places among lines that aren't blank, the words
    before and through it, and whether it may go alone."""
    doc = Window.partitionBy("id", "th").orderBy("pos")
    rows = lines.withColumn("p", F.lag("at").over(doc)).filter("p IS NULL OR p <> at")  # of a repeated row, one
    rows = rows.withColumn("p", F.lag("at").over(doc)).withColumn("ph", F.lag("h").over(doc)).withColumn("pn", F.lag("n").over(doc))
    coarse = F.col("p").isNull() | (F.col("at") - F.col("p") > 1) | (F.pmod(F.xxhash64("ph", "h"), F.lit(boundary)) == 0)
    fine = coarse | (F.col("n") != F.col("pn"))
    rows = rows.withColumn("coarse", F.sum(coarse.cast("int")).over(doc)).withColumn("fine", F.sum(fine.cast("int")).over(doc)).withColumn("through", F.sum("words").over(doc))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.col(c).alias("chunk")) for k, c in enumerate(("coarse", "fine"))])
    rows = rows.select("id", "th", "at", "pos", "h", "words", "through", F.explode(levels).alias("c"))
    ends = [f(c).alias(name) for f, c, name in ((F.min, "pos", "a"), (F.max, "pos", "b"), (F.min, "at", "fa"), (F.max, "at", "fb"), (F.sum, "words", "words"), (F.max, "through", "wb"))]
    rows = rows.groupBy("id", "th", "c.level", "c.chunk").agg(*ends, F.collect_list(F.struct("pos", "h")).alias("hs"))
    alone = ((F.col("fb") > F.col("fa")) & (F.col("words") >= least_words)) | (F.col("words") >= long_words)
    key = F.xxhash64(F.transform(F.array_sort("hs"), lambda x: x["h"])).alias("hash")
    # where both cuts agree, the chunk counts once
    return rows.select("id", "th", "a", "b", "fa", "fb", (F.col("wb") - F.col("words")).alias("wa"), "wb", alone.alias("alone"), key).distinct()


def _going(chunks: DataFrame, long_words: int) -> DataFrame:
    """Chunks that may go alone, and those that have ``long_words`` words with the chunks they adjoin."""
    doc = Window.partitionBy("id", "th").orderBy("fa", "fb")
    before = F.max("fb").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    rows = chunks.withColumn("apart", F.coalesce(F.col("fa") > before + 1, F.lit(True)).cast("int")).withColumn("run", F.sum("apart").over(doc))
    run = Window.partitionBy("id", "th", "run")
    rows = rows.withColumn("together", F.max("wb").over(run) - F.min("wa").over(run))
    return rows.filter(F.col("alone") | (F.col("together") >= long_words)).select(*chunks.columns)


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, boundary: int = BOUNDARY, long_words: int = LONG_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, th, spans): line ranges to remove, by id and text hash; only documents that have any."""
    marked = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    chunks = cut(_chunks(_repeated_lines(marked), boundary, long_words, least_words))
    again = cut(chunks.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    places = F.struct("hash", "a", "b", "fa", "fb", "wa", "wb", "alone")
    found = _going(chunks.join(again, "hash"), long_words).groupBy("id", "th").agg(F.collect_list(places).alias("chunks"))
    found = cut(found.select(F.col("id").alias("fid"), F.col("th").alias("fth"), "chunks"))
    # a text goes through a shuffle only if it may have such chunks
    whole = parted(marked, ("id", "th"), found, ("fid", "fth"))[0].join(found, (F.col("th") == F.col("fth")) & F.col("id").eqNullSafe(F.col("fid"))).withColumn("lines", _lines(F.col("text")))
    inked = F.filter(F.slice("lines", F.col("c.a") + 1, F.col("c.b") - F.col("c.a") + 1), lambda x: x.rlike(INK))
    piece = whole.select("id", "th", "lines", F.explode("chunks").alias("c")).select("id", "th", "c.*", F.array_join(inked, "\n").alias("bytes"))
    piece = stored(piece, "line-chunks")
    first = stored(piece.groupBy("hash", "bytes").agg(F.min(F.struct("id", "th", "a")).alias("first")), "first-chunks")
    later = piece.join(first, ["hash", "bytes"]).filter(~F.struct("id", "th", "a").eqNullSafe(F.col("first")))
    return _going(later, long_words).groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", boundary: int = BOUNDARY, long_words: int = LONG_WORDS, removed_col: str | None = None, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated chunks out of ``text_col``; ``removed_col``: the number of lines that went.

    ``docs`` is read several times, and must give the same rows each time.
    """
    th, sid, sth, spans, lines, keep = fresh(docs, "th", "sid", "sth", "spans", "lines", "keep")
    gone = repeated_spans(docs, id_col, text_col, boundary, long_words, least_words)
    gone = cut(gone.select(F.col("id").alias(sid), F.col("th").alias(sth), F.col("spans").alias(spans)))
    out, same = parted(docs.withColumn(th, F.xxhash64(text_col)), (id_col, th), gone, (sid, sth))
    out = out.join(gone, (F.col(th) == F.col(sth)) & F.col(id_col).eqNullSafe(F.col(sid)), "left")
    all_lines = _lines(F.col(text_col))
    out = out.withColumn(lines, F.when(F.col(spans).isNotNull(), all_lines))
    going = F.flatten(F.transform(spans, lambda s: F.sequence(s["a"], s["b"])))
    out = out.withColumn(keep, F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), going))
    left = F.array_join(F.transform(keep, lambda i: F.element_at(F.col(lines), i + 1)), "\n")
    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(left)
    names = [F.col(c) if c != text_col else text.alias(c) for c in docs.columns]
    kept = [F.col(c) for c in docs.columns]
    if removed_col:
        names.append(F.coalesce(F.when(F.col(spans).isNotNull(), F.size(lines) - F.size(keep)), F.lit(0)).cast("long").alias(removed_col))
        kept.append(F.lit(0).cast("long").alias(removed_col))
    # what loses no line stays where it was read
    return out.select(*names).union(same.select(*kept))
