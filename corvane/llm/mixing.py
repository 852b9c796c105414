"""Mixing sources to target weights.

Every record gets a hash-random key. Records are ordered by key within their source, token counts are summed
up along that order, and each source is cut at its budget: whole epochs first, then the records up to where
the rest of the budget ends. The prefix sums are distributed: keys are cut into ranges, sums by range are
added up along the ranges, and a record adds its place inside its range, so a source that holds most of all
rows is as many tasks as it has ranges.

Defined results: records of a null or unlisted source take no part. A null or empty text has no tokens and is
used as its neighbours in the order are. Equal keys are ordered by id; repeated ids are records of their own.
A source without records reaches nothing. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def source_report(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats, records, source_tokens, total_tokens, budget, epochs, rest, reachable)``.

    ``sizes`` is ``(id, source, tokens)``, ``targets`` is ``(source, target_share, max_repeats)``, one row per source.
    The budget is the target share of the tokens of all listed sources; ``epochs`` whole passes and ``rest`` tokens make
    it up, as far as ``max_repeats`` allows.
    """
    own = sizes.groupBy("source").agg(F.count("*").alias("records"), F.sum("tokens").alias("source_tokens"))
    all_in = targets.select("source", "target_share", "max_repeats").where(F.col("source").isNotNull()).join(own, "source", "left").na.fill(0, ["records", "source_tokens"])
    total = all_in.agg(F.sum("source_tokens").alias("total_tokens"))  # one row
    out = all_in.crossJoin(F.broadcast(total)).withColumn("budget", F.col("target_share") * F.col("total_tokens"))
    most = F.col("source_tokens") * F.col("max_repeats")
    out = out.withColumn("reachable", most >= F.col("budget"))
    use = F.least(F.col("budget"), most.cast("double"))
    epochs = F.when(F.col("source_tokens") > 0, F.least(F.floor(use / F.col("source_tokens")), F.col("max_repeats").cast("long"))).otherwise(F.lit(0)).cast("long")
    return out.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), use - F.col("epochs") * F.col("source_tokens")))


def mix_sources(sizes: DataFrame, id_col: str, targets: DataFrame, seed: int = 17, ranges: int | None = None) -> DataFrame:
    """``(id, source, tokens, copies)``: how often each record of the listed sources is used, 0 included.

    There are as many ``ranges`` as keep a source that holds all records at some 10,000 in each; the result doesn't depend on
    their number.
    """
    ranges = ranges or max(1_024, sizes.count() // 10_000)
    report = source_report(sizes, targets).select("source", "epochs", "rest")
    keyed = sizes.select(id_col, "source", "tokens", F.xxhash64(id_col, F.lit(seed)).alias("key"))
    keyed = keyed.withColumn("range", F.floor((F.col("key").cast("double") / 2.0**64 + 0.5) * ranges).cast("int"))
    sums = keyed.groupBy("source", "range").agg(F.sum("tokens").alias("in_range"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per source and range
    starts = sums.join(report, "source").select("source", "range", "epochs", "rest", F.coalesce(F.sum("in_range").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "range").orderBy("key", id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.join(starts, ["source", "range"]).withColumn("end", F.col("start") + F.sum("tokens").over(inside))
    more = F.when((F.col("rest") > 0) & (F.col("end") <= F.col("rest")), 1).otherwise(0)
    return placed.select(id_col, "source", "tokens", (F.col("epochs") + more).cast("int").alias("copies"))


def reached_shares(mixture: DataFrame, report: DataFrame) -> DataFrame:
    """The report with the tokens used and the share of the mixture each source actually has."""
    used = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    joined = report.join(used, "source", "left").na.fill(0, ["used_tokens", "most_copies"])
    total = joined.agg(F.sum("used_tokens").alias("mixture_tokens"))
    share = F.when(F.col("mixture_tokens") > 0, F.col("used_tokens") / F.col("mixture_tokens")).otherwise(0.0)
    return joined.crossJoin(F.broadcast(total)).withColumn("share", share)
