"""Removal of repeated line runs by prefix doubling over line ids, with DataFrame functions only.

A text is its sequence of lines, a suffix of it starts at any line. Prefix doubling ranks the suffixes by their
first 1, 2, 4, ... lines: the rank of 2h lines at a place is that of the pair of its h-line ranks there and h lines
on. Only places whose run of lines occurs more than once go on to the next round, so nearly all drop out at once, and
ranks are drawn for runs, not for places. At the wanted depth of ``min_lines`` suffixes of equal rank are one interval of
the suffix array whose longest common prefix has at least that many lines. In every interval the first suffix, by
doc_id and line, is the original and all others are later copies; their lines are deleted. Overlapping copies
chain into maximal runs: each stretch of windows that repeats one earlier stretch, reported with its source.

Deeper rounds would split these intervals and not change what is deleted, so the rounds end at ``min_lines``.

A run of fewer lines counts too if it has at least ``min_words`` words: its places are judged alike at the depth of its
length, so rounds then go up line by line. Every letter of a script written without spaces is a word. With ``min_words`` None
only runs of ``min_lines`` count.

Texts that are equal as a whole are folded first: the row with the smallest doc_id stands for all, and the others are
later copies of all its lines that a run covers. Rows equal in doc_id and text are one document and are judged alike. A run needs a line with a word;
blank lines inside it are part of it. Lines are compared by 64-bit hashes. Null texts have no lines and stay null;
an empty text is one blank line. Null doc_ids come last in the order. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from ..session import materialize

MIN_LINES = 3
#: Words that make a run of fewer than MIN_LINES lines count.
MIN_WORDS = 50
#: Thai, Lao, Myanmar, Khmer, kana and Han. Ranges, as looking up a letter's script costs several times more.
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
WORD = rf"[^\x20\x09-\x0D{UNSPACED}]++|[{UNSPACED}]"
LAST = (1 << 63) - 1


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_sizes(lines: Column, min_words: int | None) -> Column:
    """Words of each line; with ``min_words`` None just 1 for lines with a word."""
    if min_words is None:
        return F.transform(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]").cast("int"))
    return F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD)))


def line_rows(docs: DataFrame, min_lines: int, min_words: int | None) -> DataFrame:
    """(text_key, pos, line, least, first): the lines of each different text, once.

    ``least`` is the smallest number of lines from here on that count as a run: fewer than ``min_lines`` with enough words,
    or ``min_lines`` with any word; null if there is none. ``first`` is the text's smallest doc_id.
    """
    lines = split_lines(F.col("text"))
    total = lambda i, d: F.aggregate(F.slice("sizes", i + 1, d), F.lit(0), lambda a, x: a + x)
    short = lambda i: [F.when(total(i, d) >= min_words, d) for d in range(1, min_lines)] if min_words is not None else []
    least = lambda i: F.coalesce(*short(i), F.when(total(i, min_lines) > 0, min_lines))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), lines.alias("lines")).withColumn("sizes", line_sizes(F.col("lines"), min_words))
    at = lambda x, i: F.struct(F.xxhash64(x).alias("line"), least(i).alias("least"))
    each = rows.select("doc_id", "text_key", F.posexplode(F.transform("lines", at)).alias("pos", "x"))
    return each.groupBy("text_key", "pos", "x.line", "x.least").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("first"))


def _pairs(ranked: DataFrame, shift: int) -> DataFrame:
    """Ranks at each place and ``shift`` lines on, where both are repeated; a window holds one text's lines."""
    ahead = Window.partitionBy("text_key").orderBy("pos").rangeBetween(shift, shift)
    return ranked.withColumn("next", F.first("rank").over(ahead)).where("next is not null")


def double(ranked: DataFrame, shift: int) -> DataFrame:
    """Ranks of the runs that join two ranked runs ``shift`` apart, for those that occur more than once.

    ``ranked`` has text_key, pos, rank, least and first.
    """
    pairs = materialize(_pairs(ranked, shift), "line-pairs")
    runs = pairs.groupBy("rank", "next").count().where("count > 1").select("rank", "next")
    order = global_rank(runs, [F.col("rank"), F.col("next")], "joined")
    return materialize(
        pairs.join(order, ["rank", "next"]).select("text_key", "pos", F.col("joined").cast("long").alias("rank"), "least", "first"), "line-ranks"
    )


def _later_copies(ranked: DataFrame, depth: int) -> DataFrame:
    """Windows of ``depth`` lines that count and are not the first of their interval, and that first one."""
    windows = ranked.where(F.col("least") <= depth)
    place = F.struct("first", "text_key", "pos")
    intervals = windows.groupBy("rank").agg(F.min(place).alias("o"))
    return windows.join(intervals, "rank").where(place != F.col("o")).select(
        "text_key", "pos", F.lit(depth).alias("lines"), F.col("o.text_key").alias("source_key"), F.col("o.pos").alias("source_pos")
    )


def repeated_windows(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """(text_key, pos, lines, source_key, source_pos): every window that counts as a run and has an earlier copy, and the first of its interval."""
    lines = materialize(line_rows(docs, min_lines, min_words), "lines")
    often = lines.groupBy("line").count().where("count > 1").select("line")
    ranked = materialize(lines.join(often, "line").select("text_key", "pos", F.col("line").alias("rank"), "least", "first"), "line-ranks")
    depth, found = 1, []
    while depth < min_lines:
        if min_words is not None:
            found.append(_later_copies(ranked, depth))
        step = min(depth, min_lines - depth) if min_words is None else 1
        ranked = double(ranked, step)
        depth += step
    return reduce(DataFrame.unionByName, [*found, _later_copies(ranked, min_lines)])


def line_runs(windows: DataFrame) -> DataFrame:
    """(text_key, start, lines, source_key, source_start): maximal runs of windows that repeat one earlier stretch."""
    diagonal = F.col("pos") - F.col("source_pos")
    order = Window.partitionBy("text_key", "source_key", "_d").orderBy("pos", "_end")
    reach = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("pos") > F.col("_reach"), F.lit(True)).cast("int")
    placed = windows.withColumn("_d", diagonal).withColumn("_end", F.col("pos") + F.col("lines")).withColumn("_reach", reach)
    return (
        placed.withColumn("_run", F.sum(apart).over(order)).groupBy("text_key", "source_key", "_d", "_run")
        .agg(F.min("pos").alias("start"), (F.max("_end") - F.min("pos")).alias("lines"))
        .select("text_key", "start", "lines", "source_key", (F.col("start") - F.col("_d")).alias("source_start"))
    )


def clean_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text) with n_lines, n_deleted, n_runs and ``kept``, the text without its later copies.

    n_runs counts the stretches of deleted lines.
    """
    docs = docs.select("doc_id", "text")
    windows = materialize(repeated_windows(docs, min_lines, min_words), "line-windows")
    gone = windows.select("text_key", F.explode(F.sequence("pos", F.col("pos") + F.col("lines") - 1)).alias("p")).distinct()
    deleted = gone.groupBy("text_key").agg(F.sort_array(F.collect_list("p")).alias("deleted"))
    first = docs.select(F.xxhash64("text").alias("text_key"), F.coalesce("doc_id", F.lit(LAST)).alias("id")).groupBy("text_key").agg(F.min("id").alias("first"))
    about = materialize(first.join(deleted, "text_key", "left"), "line-texts")

    every = F.sequence(F.lit(0), F.size("lines") - 1)
    words = F.aggregate("sizes", F.lit(0), lambda a, x: a + x)
    later = F.coalesce("doc_id", F.lit(LAST)) != F.col("first")
    copy = later & (F.size("lines") >= min_lines) & (words > 0)
    short_copy = later & (F.size("lines") < min_lines) & (words >= min_words) if min_words is not None else F.lit(False)
    own = F.coalesce("deleted", F.array().cast("array<int>"))
    rows = docs.withColumn("text_key", F.xxhash64("text")).join(about, "text_key", "left").withColumn("lines", split_lines(F.col("text")))
    rows = rows.withColumn("sizes", F.when(later, line_sizes(F.col("lines"), min_words)))
    rows = rows.withColumn("deleted", F.when(copy, covered(every, min_lines)).when(short_copy, every).otherwise(own))
    starts = F.filter("deleted", lambda x, i: (i == 0) | (F.get(F.col("deleted"), i - 1) != x - 1))
    return rows.select(
        "doc_id", "text", F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), F.size("deleted").cast("long").alias("n_deleted"),
        F.size(starts).cast("long").alias("n_runs"),
        F.array_join(outside(F.col("lines"), F.col("deleted")), "\n").alias("kept"),
    )


def outside(lines: Column, deleted: Column) -> Column:
    """Lines at none of the places ``deleted``, which ascend: the stretches between them, so the work is linear in both."""
    before = lambda i: F.coalesce(F.get(deleted, i - 1), F.lit(-1))
    until = lambda i: F.coalesce(F.get(deleted, i), F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(deleted)), lambda i: F.slice(lines, before(i) + 2, until(i) - before(i) - 1)))


def covered(places: Column, min_lines: int) -> Column:
    """Places that lie in a window of ``min_lines`` lines with a word."""
    starts = lambda i: F.sequence(F.greatest(i - min_lines + 1, F.lit(0)), F.least(i, F.size("lines") - min_lines))
    return F.filter(places, lambda i: F.exists(starts(i), lambda s: F.exists(F.slice("sizes", s + 1, min_lines), lambda n: n > 0)))
