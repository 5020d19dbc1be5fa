"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Targets: sources in code point order (null last) weigh ``weights`` in turn and share ``share`` of all words; no
target exceeds ``cap`` times its source, and what is over is shared again by weight until none is above.

Documents: with r = target / source size, every document is certain to be taken floor(r) times whole. What is
left of the target is an unequal-probability sample of further copies. A document's inclusion probability p is
the remaining fraction of its source, less in proportion for documents under ``FULL_SIZE`` words. Its
rank is Q = (u / (1 - u)) / (p / (1 - p)) with u a random number drawn from its id: random odds over
inclusion odds. The sample is fixed in words: documents are taken in order of Q as long as the sum
stays within the target; what the first document that doesn't fit leaves open is filled from the documents after
it, at most two of each power-of-two size class, largest first, and at last by the one that brings the sum nearest.

Documents of more than a ``LARGE``-th of the target are settled first, in their order of Q, by the nearest fit to their own share
of what is left; the others make up for what that share misses or exceeds.

The cut in the order is found without sorting a source: words are summed per leading 16 bits of Q, then, inside
the one bin where the target falls, per next 16 bits, then per value. No task sees more than 65,536 sums of a source.

Size is the number of runs of non-white-space in the text; null texts have size 0 and are never taken. Rows with one
doc_id in a source share their random number and are taken or left together; null ids do as well. Reruns agree.
A null source is a source of its own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from ..session import materialize

WEIGHTS = (3, 1, 2)
FULL_SIZE = 50
LARGE = 16
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(per_source: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Each round is one sum over the sources: those above their cap are fixed there, and the open ones' share
    grows. It only grows, so the rounds end; few are needed.
    """
    ranked = global_rank(per_source, [F.col("source").asc_nulls_last()], "_rank")
    cycle = F.array(*[F.lit(w) for w in weights])
    t = materialize(ranked.select("source", "source_size", F.element_at(cycle, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).alias("weight")), "mix-sources")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    limit = (F.col("source_size") * cap).cast("double")
    target, last = limit, None
    above = F.lit(False)
    while True:
        row = t.agg(F.sum(F.when(above, F.col("source_size") * cap)).alias("fixed"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            target = limit
            break
        left, parts = share[0] * total - share[1] * (row["fixed"] or 0), share[1] * row["open"]
        if (left, parts) == last:
            break
        last = (left, parts)
        even = F.col("weight") * F.lit(float(left)) / F.lit(float(parts))
        above, target = even > limit, F.least(even, limit)
    return t.select("source", "source_size", target.alias("target"))


def random_odds(doc_id: Column) -> Column:
    """u / (1 - u) for u from 48 bits of a digest of the id."""
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return u / (1 - u)


def order_key(doc_id: Column, size: Column, fraction: Column) -> Column:
    """Place of Q / (1 + Q) among 2**48; grows with Q."""
    p = fraction * F.least(size, F.lit(FULL_SIZE)).cast("double") / float(FULL_SIZE)
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    q = random_odds(doc_id) / (p / (1 - p))
    return F.floor(q / (1 + q) * float(1 << 48)).cast("long")


def _crossing(sums: DataFrame, by: str, room: str) -> DataFrame:
    """Of each source the first ``by`` where the running sum passes ``room``, with the sum before it as ``used``."""
    order = Window.partitionBy("sid").orderBy(by)
    cum = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    passed = sums.withColumn("_cum", cum).where(F.col("_cum") > F.col(room))
    return passed.groupBy("sid").agg(F.min_by(F.struct(by, (F.col("_cum") - F.col("words")).alias("used"), room), by).alias("x")).select("sid", "x.*")


def _large_first(keyed: DataFrame, t: DataFrame, cap: int) -> DataFrame:
    """Add to each source the large documents taken once more, and what that leaves to the small ones.

    A source has at most ``LARGE`` large documents for every time its target goes into it.
    """
    small = keyed.where(~F.col("large")).groupBy("sid").agg(F.sum("size").alias("small"))
    blocks = keyed.where("large").groupBy("sid", "key").agg(F.sum("size").cast("double").alias("words"))
    large = blocks.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("key", "words"))).alias("c"), F.sum("words").alias("all"))
    t = t.join(small, "sid", "left").join(large, "sid", "left").withColumn("small", F.coalesce("small", F.lit(0)))
    begin = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<bigint>").alias("keys"))
    add = lambda acc, x: F.struct((acc["sum"] + x["words"]).alias("sum"), F.array_append(acc["keys"], x["key"]).alias("keys"))
    near = lambda acc, x: F.when((acc["sum"] + x["words"] / 2 <= F.col("fraction") * F.col("all")) & (acc["sum"] + x["words"] <= F.col("rest")), add(acc, x)).otherwise(acc)
    # More of them if the small documents can't take what is left even at the cap.
    needed = lambda acc, x: F.when(
        ~F.array_contains(acc["keys"], x["key"]) & (F.col("rest") - acc["sum"] > F.col("small") * (cap - F.col("whole"))) & (acc["sum"] + x["words"] <= F.col("rest")), add(acc, x)
    ).otherwise(acc)
    t = t.withColumn("_l", F.aggregate("c", begin, near)).withColumn("_l", F.aggregate("c", F.col("_l"), needed))
    left = F.least(F.col("rest") - F.coalesce(F.col("_l.sum"), F.lit(0.0)), (F.col("small") * (cap - F.col("whole"))).cast("double"))
    t = t.withColumn("large_taken", F.coalesce("_l.keys", F.array().cast("array<bigint>"))).withColumn("left", left)
    more = F.when(F.col("small") > 0, F.floor(F.col("left") / F.col("small"))).otherwise(0).cast("long")
    return t.withColumn("whole_small", F.col("whole") + more).withColumn("room0", F.col("left") - more * F.col("small")).drop("c", "all", "_l", "left", "small")


def mixing_plan(sized: DataFrame, cap: int = 2, **options) -> DataFrame:
    """(source, source_size, target, large_from, whole, whole_small, fraction, large_taken, cut, filled) by source.

    ``sized`` has doc_id, source and size. A document of at least ``large_from`` words is taken ``whole`` times, once more if
    its order key is in ``large_taken``; any other ``whole_small`` times, once more if its key lies below ``cut`` or is in ``filled``.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = source_targets(per_source, cap=cap, **options)
    s = F.col("source_size")
    whole = F.when(s > 0, F.floor(F.col("target") / s)).otherwise(0).cast("long")
    rest = F.col("target") - F.col("whole") * s
    t = t.withColumn("whole", whole).withColumn("rest", rest).withColumn("fraction", F.when(s > 0, F.col("rest") / s).otherwise(0.0))
    t = t.withColumn("large_from", F.floor(F.col("target") / LARGE) + 1)
    t = materialize(t.withColumn("sid", F.xxhash64(F.col("source").isNull(), "source")), "mix-targets")

    keyed = sized.where("size > 0").withColumn("sid", F.xxhash64(F.col("source").isNull(), "source")).join(t.where("rest > 0").select("sid", "large_from", "fraction"), "sid")
    keyed = keyed.select("sid", "size", order_key(F.col("doc_id"), F.col("size"), F.col("fraction")).alias("key"), (F.col("size") >= F.col("large_from")).alias("large"))
    keyed = materialize(keyed.withColumn("b1", F.shiftright("key", 32)).withColumn("b2", F.shiftright("key", 16)), "mix-keys")
    t = materialize(_large_first(keyed, t, cap), "mix-large")
    keyed = keyed.where(~F.col("large")).join(t.select("sid", F.col("room0").alias("rest")), "sid")
    sums = lambda df, *by: df.groupBy("sid", *by).agg(F.sum("size").alias("words"))
    first = _crossing(sums(keyed, "rest", "b1"), "b1", "rest").select("sid", "b1", (F.col("rest") - F.col("used")).alias("room1"))
    inside = keyed.join(first, ["sid", "b1"])
    second = _crossing(sums(inside, "room1", "b2"), "b2", "room1").select("sid", "b2", (F.col("room1") - F.col("used")).alias("room2"))
    inside = keyed.select("sid", "b2", "key", "size").join(second, ["sid", "b2"])
    cut = _crossing(sums(inside, "room2", "key"), "key", "room2").select("sid", F.col("key").alias("cut"), (F.col("room2") - F.col("used")).alias("room"))
    cut = materialize(cut, "mix-cuts")

    # The first document of each size class after the cut, once among even and once among odd keys.
    after = keyed.join(cut, "sid").where("key >= cut and size <= 2 * room")
    picks = after.groupBy("sid", F.floor(F.log2("size")).alias("_class"), F.expr("key % 2").alias("_half")).agg(F.min("key").alias("key"))
    blocks = after.join(picks.select("sid", "key").distinct(), ["sid", "key"]).groupBy("sid", "key", "room").agg(F.sum("size").alias("words"))
    ordered = blocks.groupBy("sid", "room").agg(F.sort_array(F.collect_list(F.struct("words", "key")), asc=False).alias("c"))
    start = F.struct(F.col("room").cast("double").alias("room"), F.array().cast("array<bigint>").alias("keys"))
    step = lambda acc, x: F.when(
        x["words"] <= acc["room"],
        F.struct((acc["room"] - x["words"]).cast("double").alias("room"), F.array_append(acc["keys"], x["key"]).alias("keys")),
    ).otherwise(acc)
    fold = ordered.withColumn("f", F.aggregate("c", start, step))
    open_ = F.filter("c", lambda x: ~F.array_contains(F.col("f.keys"), x["key"]) & (x["words"] < 2 * F.col("f.room")))
    nearest = F.array_min(F.transform(open_, lambda x: F.struct(F.abs(x["words"] - F.col("f.room")).alias("off"), x["key"].alias("key"))))
    filled = fold.withColumn("nearest", nearest["key"]).select(
        "sid", F.when(F.col("nearest").isNull(), F.col("f.keys")).otherwise(F.array_append(F.col("f.keys"), F.col("nearest"))).alias("filled")
    )
    return materialize(
        t.drop("rest", "room0").join(cut.drop("room"), "sid", "left").join(filled, "sid", "left").drop("sid"), "mix-plan"
    )


def with_copies(docs: DataFrame, plan: DataFrame, size: Column) -> DataFrame:
    """``docs`` (doc_id, source, ...) with the plan of its source and ``copies``, the times that the mix takes each document."""
    plan = plan.select(*[F.col(c).alias(f"_{c}") for c in plan.columns])
    joined = docs.withColumn("_size", size).join(plan, F.col("source").eqNullSafe(F.col("_source")))
    key = order_key(F.col("doc_id"), F.col("_size"), F.col("_fraction"))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    small = F.col("_whole_small") + yes((key < F.col("_cut")) | F.coalesce(F.array_contains("_filled", key), F.lit(False)))
    large = F.col("_whole") + yes(F.array_contains("_large_taken", key))
    copies = F.when(F.col("_size") >= F.col("_large_from"), large).otherwise(small)
    return joined.withColumn("copies", F.when(F.col("_size") > 0, copies).otherwise(0).cast("long"))


def sizes(docs: DataFrame) -> DataFrame:
    return materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs`` (doc_id, source, text)."""
    sized = sizes(docs)
    chosen = with_copies(sized, mixing_plan(sized, **options), F.col("size"))
    return chosen.select(
        "doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    chosen = with_copies(rows, mixing_plan(sizes(docs), **options), F.col("size")).where("copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
