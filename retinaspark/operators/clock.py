"""Samples with a clock of their own, such as frames and IMU readings, put to slices and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stream import EventStream


def alongside(slices: DataFrame, samples: DataFrame, dt: int, t: str = "t") -> DataFrame:
    """The samples at t0 <= t < t1 of each slice, with its ``slice_id``; slices may overlap.

    ``dt`` is the slices' length: both sides meet in buckets of it, so the range
    join is a hash join on buckets with a filter.
    """
    spread = slices.select("slice_id", "t0", "t1", F.explode(F.sequence(F.expr(f"t0 div {int(dt)} - 1"), F.expr(f"t1 div {int(dt)} + 1"))).alias("_bucket"))
    met = samples.withColumn("_bucket", F.expr(f"`{t}` div {int(dt)}")).join(spread, "_bucket").where((F.col(t) >= F.col("t0")) & (F.col(t) < F.col("t1")))
    return met.select("slice_id", *[F.col(f"`{c}`") for c in samples.columns])


def until_next(samples: DataFrame, bucket: int, t: str = "t") -> DataFrame:
    """The samples with the next one's time in ``next_t``, null for the last.

    Next times within a bucket come from a window over it, those across buckets
    from the table of buckets, so no task orders all samples.  Of samples at one
    time all have the next other time.
    """
    times = samples.select(F.col(t).alias("t")).distinct().withColumn("_bucket", F.expr(f"t div {int(bucket)}"))
    firsts = times.groupBy("_bucket").agg(F.min("t").alias("_first"))
    # a row for each bucket that has samples
    firsts = firsts.select("_bucket", F.lead("_first").over(Window.orderBy("_bucket")).alias("_after"))
    within = F.lead("t").over(Window.partitionBy("_bucket").orderBy("t"))
    ends = times.withColumn("_next", within).join(firsts, "_bucket").select(F.col("t").alias("_at"), F.coalesce("_next", "_after").alias("next_t"))
    return samples.join(ends, F.col(t) == F.col("_at")).drop("_at")


def latest_sample(s: EventStream, samples: DataFrame, columns: list[str], bucket: int = 100_000, t: str = "t") -> DataFrame:
    """Each event with the columns of the latest sample at or before it; null before the first.

    A sample is good for the buckets of time up to the next one, and meets the
    events there; of samples at one time the one with the largest values counts.
    """
    one = samples.groupBy(F.col(t).alias("_t")).agg(F.max(F.struct(*columns)).alias("_s"))
    last = s.df.agg(F.max("t").alias("_last"))
    good = until_next(one, bucket, "_t").join(F.broadcast(last), F.lit(True))
    good = good.withColumn("_end", F.coalesce("next_t", F.greatest(F.col("_last"), F.col("_t")) + 1)).where(F.col("_t") <= F.col("_last"))
    spread = good.select("_t", "_end", "_s", F.explode(F.sequence(F.expr(f"_t div {int(bucket)}"), F.expr(f"least(_end, _last) div {int(bucket)}"))).alias("_bucket"))
    asked = s.df.withColumn("_bucket", F.expr(f"t div {int(bucket)}"))
    met = asked.join(spread, (asked["_bucket"] == spread["_bucket"]) & (asked["t"] >= spread["_t"]) & (asked["t"] < spread["_end"]), "left")
    return met.select(*[asked[c] for c in s.columns], *[F.col(f"_s.{c}").alias(c) for c in columns])
