"""Mixing sources to target weights along a time-varying curriculum, with Spark expressions only.

A document's size is its number of words. Sources by code point (null last) take ``WEIGHTS`` in turn and share
``SHARE`` of all words; a target stops at ``CAP`` times its source's size and the excess is shared again by weight.
Each source goes through its documents in the order of a hash of their ids, again from the start once they are used
up, until its target is reached; the last document is cut at a word.

When a word is used follows from its source's weight schedule, a piecewise linear function of training time: the
schedule's integral is the demand up to a time, and inverting it at the words used so far gives the training position
of each copy. Copies are then range-sorted by position.

A source may hold a third of all rows, so running totals are taken in two steps: over hash ranges of each source, from sums
made before the shuffle, then within a range. The ranges grow with the rows, so that one has about ``RANGE`` rows at most. What
is done in one task are a row for each source, and a row for each range of a source.

Nulls: a null text has size 0, a null source is a source of its own, rows with a null or repeated ``doc_id`` are
documents like any other; those without one are ordered by a hash of a row number. A corpus without words takes nothing.
Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, text_or_empty

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Rows of a hash range, about, and the fewest hex digits that tell ranges apart.
RANGE, LEAST_DIGITS = 1 << 18, 3
#: Knots (time, weight) of the schedules, dealt to the sources in turn like ``WEIGHTS``: early, late, even.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
    ((0.0, 1.0), (1.0, 1.0)),
)


def word_count(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """source, source_size, rank from 0, target. ``sizes``: source, size.

    Water-filling in closed form: with sources by how soon they fill up, ``cap * size / weight``, the level is
    (all - what the first k take) / (the others' weight) for the first k at which no further source is above its cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", "rank")
    ranked = per.withColumn("rank", F.row_number().over(by_name) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % n + 1).cast("int")).cast("double"))
    filled = (
        weighed.withColumn("most", (cap * F.col("source_size")).cast("double"))
        .withColumn("fill", F.col("most") / F.col("weight"))
        .withColumn("wanted", share * F.sum("source_size").over(everything))
        .withColumn("before", F.sum("most").over(by_fill) - F.col("most"))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.sum("weight").over(by_fill) + F.col("weight"))
        .withColumn("level", (F.col("wanted") - F.col("before")) / F.col("weight_left"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("fill"), F.struct(F.col("fill"), F.col("rank"), F.col("level")))).over(everything)["level"])
    )
    return filled.select("source", "source_size", "rank", F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most")).alias("target"))


def training_time(used: Column, kind: Column, schedules=SCHEDULES) -> Column:
    """When a share ``used`` of a source's words has been demanded, by the schedule of index ``kind``: 0 to 1."""

    def invert(knots) -> Column:
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        demand, done = used * sum(areas), 0.0
        out = F.lit(1.0)
        for a, b, area in reversed([(a, b, x) for a, b, x in zip(knots, knots[1:], areas)]):
            done = sum(areas[: [k[0] for k in knots].index(a[0])])
            slope, left = (b[1] - a[1]) / (b[0] - a[0]), demand - done
            at = a[0] + 2 * left / (a[1] + F.sqrt(F.greatest(F.lit(0.0), a[1] * a[1] + 2 * slope * left)))
            out = F.when(demand <= done + area, at).otherwise(out)
        return out

    out = invert(schedules[-1])
    for i, knots in enumerate(schedules[:-1]):
        out = F.when(kind % len(schedules) == i, invert(knots)).otherwise(out)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def _placed(sizes: DataFrame) -> DataFrame:
    """The plan of a table (row, doc_id, source, size): its columns, source_size, target, taken, take_1, take_2, position_1,
    position_2."""
    digits = LEAST_DIGITS
    while sizes.count() > RANGE * 16**digits:
        digits += 1
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string"))), F.lit(" "), F.col("size").cast("string")))
    sizes = sizes.withColumn("h", order).withColumn("bucket", F.substring("h", 1, digits))
    targets = source_targets(sizes)
    ranges = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("range_size"))
    so_far = Window.partitionBy("source").orderBy("bucket")
    starts = materialize(
        ranges.withColumn("start", F.sum("range_size").over(so_far) - F.col("range_size"))
        .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start", "source_size", "rank", "target"),
        "starts",
    )
    within = Window.partitionBy("s", "b").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        sizes.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("before", F.col("start") + F.sum("size").over(within) - F.col("size"))
    )
    goal = F.round("target").cast("long")
    take = lambda before: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - before))
    first, second = F.col("before"), F.col("before") + F.col("source_size")
    at = lambda before, taken: F.when(F.col(taken) > 0, training_time(before / F.col("target"), F.col("rank")))
    return (
        placed.withColumn("take_1", take(first))
        .withColumn("take_2", take(second))
        .select(
            "row", "doc_id", "size", "source_size", "target", (F.col("take_1") + F.col("take_2")).alias("taken"), "take_1", "take_2",
            at(first, "take_1").alias("position_1"), at(second, "take_2").alias("position_2"),
        )
    )


def plan_mix(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, size, source_size, target, taken, and for the first and second use of the
    document the words taken and the training position (null if it isn't used): take_1, take_2, position_1, position_2."""
    sizes = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", word_count().alias("size"))
    return _placed(materialize(sizes, "sizes")).drop("row")


def _numbered(docs: DataFrame, row: str | None) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``__row``, and their sizes: row, doc_id, source, size."""
    if row is None:
        rows = materialize(docs.withColumns({"__row": F.monotonically_increasing_id(), "__size": word_count()}), "rows")
        return rows, rows.select(F.col("__row").alias("row"), "doc_id", "source", F.col("__size").alias("size"))
    rows = docs.withColumn("__row", F.col(row))
    return rows, materialize(rows.select(F.col("__row").alias("row"), "doc_id", "source", word_count().alias("size")), "sizes")


def _mixed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """A row per copy: the columns of ``rows`` and ``__use`` (epoch, take_words, position), range-sorted by position."""
    uses = F.array(*(F.struct(F.lit(k).alias("epoch"), F.col(f"take_{k}").alias("take_words"), F.col(f"position_{k}").alias("position")) for k in (1, 2)))
    copies = plan.select(F.col("row").alias("__row"), F.explode(F.filter(uses, lambda u: u["take_words"] > 0)).alias("__use"))
    return rows.join(copies, "__row").orderBy("__use.position", "__row", "__use.epoch")


def curriculum(docs: DataFrame, row: str | None = None) -> DataFrame:
    """The mix itself: a row per copy with the columns of ``docs``, epoch, take_words and position, range-sorted by
    position. The first ``take_words`` words of a copy are its part of the mix.

    Rows are placed each on its own, whatever ids they have or share. A column of ``docs`` with the name of an added one
    stays; the added one's name then ends in an underscore. ``row``: a column that tells all rows apart and is the same
    whenever they are read, as their place in a file is; without one the rows are written once with a number.
    """
    rows, sizes = _numbered(docs, row)
    mixed = _mixed(rows, _placed(sizes))
    name = lambda c: c if c not in docs.columns else name(c + "_")
    return mixed.select(*docs.columns, *(F.col(f"__use.{c}").alias(name(c)) for c in ("epoch", "take_words", "position")))


def digest(docs: DataFrame, row: str | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, size, source_size, target, and what the mix of ``curriculum`` holds of it, read from
    the sorted copies and their texts: taken, position_1, position_2 (null if it isn't used). ``row`` as there."""
    rows, sizes = _numbered(docs, row)
    plan = materialize(_placed(sizes), "plan")
    words = F.least(F.col("__use.take_words"), word_count()).alias("words")
    order = materialize(_mixed(rows, plan).select(F.col("__row").alias("row"), "__use.epoch", words, "__use.position"), "order")
    at = lambda k: F.max(F.when(F.col("epoch") == k, F.col("position"))).alias(f"position_{k}")
    used = order.groupBy("row").agg(F.sum("words").alias("taken"), at(1), at(2))
    taken = F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    return plan.select("row", "doc_id", "size", "source_size", "target").join(used, "row", "left").select("doc_id", "size", "source_size", "target", taken, "position_1", "position_2")
