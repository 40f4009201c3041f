"""Mixing sources to target weights.

Sizes are code points of the raw texts, one record per id however often it was delivered.  A source's rate is
``weight x mix / size``, at most ``max_repeat``; every record is then emitted floor(rate) times plus once more
with a probability equal to the fraction, drawn from a hash of seed and id, so that a re-run, a retry or another
partitioning emits the same records.

Defined cases: source names are trimmed and in lower case; null texts have size 0 and are emitted like others
of their source; null ids are no records; sources that aren't in the targets are left out of the mix; a target
without records has rate 0; a null weight is 0 and a null max_repeat 1; target rows of one name are added up.

A source that falls short leaves its share empty, so that the others hold more of what is emitted than they were to.  With
``refill`` the others are raised in the proportion of their weights until the mix is full, or every source is at its cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BROADCAST_TARGETS = 100_000


def _name(source: Column) -> Column:
    return F.lower(F.btrim(source, F.lit(" \t\r\n ")))


def records(df: DataFrame, id_col: str = "sent_id", source: str = "source", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per id: id, source, size, and the columns to ``keep``.  Only these are shuffled.

    Of several deliveries the one with the last source, then the largest size, then the largest kept values is taken.
    """
    size = F.coalesce(F.length(text), F.lit(0)).cast("long").alias("size")
    return (
        df.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.struct(_name(F.col(source)).alias("source"), size, *(F.col(c).alias(f"_{c}") for c in keep))).alias("r"))
        .select("id", "r.source", "r.size", *(F.col(f"r._{c}").alias(c) for c in keep))
    )


def mix_plan(recs: DataFrame, targets: DataFrame, refill: bool = False) -> DataFrame:
    """One row per target: source, weight, max_repeat, records, size, mix, rate, short."""
    wanted = (
        targets.where(F.col("source").isNotNull())
        .groupBy(_name(F.col("source")).alias("source"))
        .agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeat", F.lit(1))).cast("long").alias("max_repeat"))
    )
    sizes = recs.groupBy("source").agg(F.count("*").alias("records"), F.sum("size").alias("size"))
    sized = wanted.join(sizes, "source", "left").select("source", "weight", "max_repeat", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("size", F.lit(0)).alias("size"))
    every = Window.partitionBy(F.lit(0))  # a row per target
    share, cap = F.col("weight") * F.col("mix"), F.col("max_repeat") * F.col("size")
    sized = sized.withColumn("mix", F.sum("size").over(every)).withColumn("level", F.col("mix").cast("double"))
    if refill:
        # From the source that fills first: what the mix lacks after those before it, by the weights from it on.  The level
        # is the first at which no further source is at its cap.
        by = Window.partitionBy(F.lit(0)).orderBy(F.when(F.col("weight") > 0, cap / F.col("weight")).otherwise(float("inf")), "source")
        before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        level = (F.col("mix") - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(after)
        sized = sized.withColumn("at", F.when(F.col("weight") > 0, level)).withColumn("level", F.coalesce(F.min(F.when(cap >= F.col("at") * F.col("weight"), F.col("at"))).over(every), F.lit(float("inf")))).drop("at")
    rate = F.when((F.col("size") > 0) & (F.col("weight") > 0), F.least(F.col("weight") * F.col("level") / F.col("size"), F.col("max_repeat").cast("double"))).otherwise(0.0)
    return sized.select("source", "weight", "max_repeat", "records", "size", "mix", rate.alias("rate"), (share > cap).alias("short"))


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of a hash of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:").cast("binary"), id_col.cast("string").cast("binary")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix_emit(recs: DataFrame, plan: DataFrame, seed: int = 0, targets: int | None = None) -> DataFrame:
    """The mix: the columns of ``recs`` and copy (1, 2, ...).

    The plan has a row per target; ``targets`` is how many there are, where the caller knows it.  Up to
    ``BROADCAST_TARGETS`` of them it is broadcast, so that a source of a third of all records is no key of a shuffle.
    """
    rates = plan.where("rate > 0").select("source", "rate")
    rates = F.broadcast(rates) if (plan.count() if targets is None else targets) <= BROADCAST_TARGETS else rates
    whole = F.floor("rate")
    copies = (whole + F.when(uniform(F.col("id"), seed) < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    kept = [c for c in recs.columns if c not in ("id", "source", "size")]
    return (
        recs.join(rates, "source")
        .withColumn("__copies", copies)
        .where("__copies > 0")
        .select("id", "source", "size", *kept, F.explode(F.sequence(F.lit(1), "__copies")).alias("copy"))
    )


def mix_report(recs: DataFrame, plan: DataFrame, seed: int = 0, targets: int | None = None) -> DataFrame:
    """What every source was to hold and really holds, by size."""
    got = mix_emit(recs, plan, seed, targets).groupBy("source").agg(F.count("*").alias("emitted"), F.sum("size").alias("emitted_size"))
    each = plan.join(got, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("emitted", "emitted_size")})
    return each.withColumn("total", F.sum("emitted_size").over(Window.partitionBy(F.lit(0)))).select(
        "source", "weight", "max_repeat", "records", "size", F.round("rate", 6).alias("rate"), "emitted", "emitted_size",
        F.round(F.when(F.col("total") > 0, F.col("emitted_size") / F.col("total")).otherwise(0.0), 6).alias("share"), "short",
    )
