"""Mixing sources to target weights along a time-varying curriculum, by DataFrame functions alone.

Targets: sources in code point order, null last, have weights; together they get
``share`` times all words.  No source gets more than ``most`` times its own
words; what is above that goes to the others by weight, again and again until
none is above.

Curriculum: each source's weight may follow a schedule of straight lines over
training time 0..1, (time, factor) points.  The schedule's integral up to t, over
its integral up to 1, is the share of the source's target that has been asked
for by then.  Documents of a source stand in a keyed random order; each pass
over them asks for their words in that order, and a document's position is the
time at which half of its words have been asked for: the inverse of the
integral, which has a closed form on each line.  Sorting all sources' documents
by position (a range sort) interleaves them as scheduled.

Repeats: every document of a source is taken floor(target / size) times in whole
passes; a last, partial pass takes the documents that lie wholly within the
remaining words at the front of the order.  The gap that the document across the
mark leaves is filled with later documents of at most an eighth of it, in order,
or with that document, whichever comes nearer to the target.

The order's prefix sums are two-level: documents fall in buckets by the leading
bits of their hash, (source, bucket) sums are prefix-summed first, and the
running sum within a bucket adds to its base.  Buckets are as many as keep
``bucket_rows`` rows or so in each, so a source with most of the rows is still
dealt out evenly.

Nulls: a null text has size 0.  A null source is a source of its own, last.
Null doc_ids, equal doc_ids and equal rows each stay as rows; rows equal in
doc_id, source and text are interchangeable.  A source without words gets a
target of 0.  Extra columns don't matter.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bits of the hash that documents are ordered by.
ORDER_BITS = 60
#: Sources' weights, in turn.
WEIGHTS = (5.0, 2.0, 1.0)
#: Factors on a source's weight by training time, in turn with the weights.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))


def weighed(sources: DataFrame, weights, share: float, most: float) -> DataFrame:
    """``sources`` (source, n) with sid, source_size and target.

    In the end some sources are at ``most`` times their size and the others at
    one multiple of their weights.  Taken by the multiple at which each would be
    full, those that are full come first; the multiple of the rest is what is
    left over their weights, at the first source that this doesn't fill.
    """
    # windows over a row for each source, not for each document
    sid = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).cast("long") - 1
    rows = sources.select("source", F.col("n").cast("long").alias("source_size"), sid.alias("sid"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("full", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("full", "sid")
    before = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(most))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(min(share, most)))
    steps = common.written(rows.withColumn("at", (whole - before) / rest), "sources")
    level = steps.where(F.col("full") > F.col("at")).agg(F.min_by("at", F.struct("full", "sid")).alias("level"))
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.coalesce(F.col("weight") * F.col("level"), F.lit(float("inf"))))
    return steps.join(F.broadcast(level), F.lit(True)).select("source", "sid", "source_size", target.alias("target"))


def targets(sizes: list[float], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """The same, step by step: split ``total`` by weight, no part above ``most`` times its size; the excess goes to the rest by weight."""
    out, open_ = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    left = min(total, most * sum(sizes))
    while open_:
        per = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if weights[i] * per >= most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = weights[i] * per
            break
        for i in above:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


def _order(seed: int, key, text):
    """The keyed random order: the leading bits of an MD5 sum, which any engine can make."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.lit(str(seed)), key.cast("string"), text)), 1, ORDER_BITS // 4), 16, 10).cast("long")


def _pieces(schedule) -> list[tuple[float, float, float, float]]:
    """(time, factor, slope, integral before, as a share of the whole) of each line of a schedule."""
    lines, total = [], 0.0
    for (t0, f0), (t1, f1) in zip(schedule, schedule[1:]):
        lines.append((t0, f0, (f1 - f0) / (t1 - t0), total))
        total += (f0 + f1) / 2 * (t1 - t0)
    if total <= 0 or min(f for _, f in schedule) < 0:
        raise ValueError("a schedule's factors must not be negative, and not all zero")
    return [(t, f / total, s / total, before / total) for t, f, s, before in lines]


def _time(asked, schedule):
    """The time at which the share ``asked`` of a source's words has been asked for."""
    out = None
    for t, f, slope, before in reversed(_pieces(schedule)):
        due = F.greatest(asked - F.lit(before), F.lit(0.0))
        # due = f * d + slope * d**2 / 2, in the form that doesn't cancel
        root = F.sqrt(F.greatest(F.lit(f * f) + due * F.lit(2 * slope), F.lit(0.0)))
        step = F.when(due == 0, 0.0).otherwise(2 * due / (F.lit(f) + root))
        here = F.lit(t) + step
        out = here if out is None else F.when(asked < F.lit(follows), here).otherwise(out)
        follows = before
    return F.least(out, F.lit(1.0))


def plan(docs: DataFrame, *, weights=WEIGHTS, schedules=SCHEDULES, share: float = 1.5, most: float = 2.0, seed: int = 7, bucket_rows: int = 2000, key: str = "doc_id", text: str = "text", source: str = "source", keep: bool = False) -> DataFrame:
    """Of each row: key, source, size, source_size, target, copies, taken, positions; with ``keep`` the row itself in ``row``.

    ``positions``: of each copy, from 0 to 1, in order; see ``placed``.
    """
    made = [docs[key].alias("key"), docs[source].alias("source"), common.count_words(docs[text]).alias("size"), _order(seed, docs[key], docs[text]).alias("h")]
    sized = common.written(docs.select(*made), "sizes")
    # strings compare by their UTF-8 bytes, which is code point order
    table = weighed(sized.groupBy("source").agg(F.sum("size").alias("n")), weights, share, most)
    table = common.written(table.select(F.col("source").alias("s_"), "sid", "source_size", "target", (F.col("sid") % len(schedules)).cast("int").alias("turn")), "targets")
    n_sources, n_rows = table.count(), sized.count()
    few = n_sources <= 10_000
    bits = max(0, (max(1, n_rows // bucket_rows) - 1).bit_length())

    def slotted(rows: DataFrame) -> DataFrame:
        # short rows, and so few that they may be broadcast
        small = F.broadcast(table) if few else table
        rows = rows.join(small, F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
        bucket = F.shiftright("h", ORDER_BITS - bits) if bits else F.lit(0).cast("long")
        return rows.withColumn("slot", F.shiftleft("sid", 42).bitwiseOR(bucket))

    def running(rows: DataFrame, what, name: str, bases: DataFrame) -> DataFrame:
        """Adds the sum of ``what`` over the rows of the source that come before."""
        within = Window.partitionBy("slot").orderBy("h", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn(name, F.coalesce(F.sum(what).over(within), F.lit(0)))
        return rows.join(bases, "slot").withColumn(name, F.col(name) + F.col(f"{name}_base")).drop(f"{name}_base")

    def bases(rows: DataFrame, what, name: str) -> DataFrame:
        # a row for each source and bucket, not for each document
        order = Window.partitionBy("sid").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.groupBy("sid", "slot").agg(F.sum(what).alias("n"))
        return common.written(sums.select("slot", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long").alias(f"{name}_base")), "bases")

    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    open_ = whole < F.lit(int(most))
    front = open_ & (F.col("before") + F.col("size") <= rest)
    across = open_ & (F.col("before") < rest) & (F.col("before") + F.col("size") > rest)
    sized = slotted(sized)
    first_bases = bases(sized, F.col("size"), "before")
    ordered = common.written(running(sized, F.col("size"), "before", first_bases), "ordered")
    gaps = ordered.groupBy("sid").agg(F.first(rest).alias("rest"), F.coalesce(F.sum(F.when(front, F.col("size"))), F.lit(0)).alias("in_front"), F.coalesce(F.max(F.when(across, F.col("size"))), F.lit(0)).alias("across")).select("sid", (F.col("rest") - F.col("in_front")).alias("gap"), "across")
    gaps = common.written(gaps, "gaps")

    def gapped(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(gaps) if few else gaps, "sid")

    little = open_ & ~front & ~across & (F.col("size") <= F.col("gap") / 8)
    ordered = gapped(ordered)
    fill = F.when(little, F.col("size")).otherwise(F.lit(0))
    second_bases = bases(ordered, fill, "filled")
    filler = little & (F.col("filled") + F.col("size") / 2.0 < F.col("gap"))
    after = running(ordered, fill, "filled", second_bases).groupBy("sid").agg(F.first("gap").alias("gap"), F.first("across").alias("across"), F.coalesce(F.sum(F.when(filler, F.col("size"))), F.lit(0)).alias("n"))
    choice = common.written(after.select("sid", (F.abs(F.col("gap") - F.col("across")) < F.abs(F.col("gap") - F.col("n"))).alias("by_across")), "choice")
    rows = slotted(docs.select(*made, F.struct(*[docs[c] for c in docs.columns]).alias("row"))) if keep else sized
    rows = running(running(gapped(rows), F.col("size"), "before", first_bases), fill, "filled", second_bases)
    rows = rows.join(F.broadcast(choice) if few else choice, "sid")
    extra = front | (across & F.col("by_across")) | (filler & ~F.col("by_across"))
    rows = rows.withColumn("copies", whole + F.coalesce(extra, F.lit(False)).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))

    def position(n):
        asked = F.when(F.col("target") > 0, F.least((n * F.col("source_size") + F.col("before") + F.col("size") / 2.0) / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
        out = _time(asked, schedules[0])
        for i, s in enumerate(schedules[1:], 1):
            out = F.when(F.col("turn") == i, _time(asked, s)).otherwise(out)
        return out

    positions = F.transform(F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(F.array().cast("array<long>")), position)
    rows = rows.withColumn("positions", positions)
    return rows.select("key", "source", "size", "source_size", "target", "copies", "taken", "positions", "h", *(["row"] if keep else []))


def placed(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it is taken, in training order."""
    rows = plan(docs, keep=True, **options).select("row", "h", "key", F.explode("positions").alias("position"))
    return rows.orderBy("position", "h", "key").select("row.*")
