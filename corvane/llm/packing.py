"""Filling fixed-capacity containers by optimal length buckets.

The histogram of sizes, which has at most one row per size up to the capacity, decides everything: dynamic
programming picks the bucket boundaries of least padding, token-budget batches are formed inside each bucket,
and the room a batch leaves is topped up with batches of smaller buckets. The plan is a short list of patterns
("so many of this bucket, so many of that"), and an item finds its container from its rank in its bucket by
arithmetic. Ranks come from counts by (bucket, salt), so no bucket is ever in one task, and texts don't move.

Defined results: an item is split only if it alone exceeds the capacity, into full containers and a rest that
is packed like any item. An item of no tokens, null texts included, takes no room and has container null.
Repeated ids are items of their own. Extra columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.tokens import token_count
from corvane.session import cut_lineage


def bucket_bounds(sizes: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over ascending sizes that minimise the total padding."""
    n = len(sizes)
    if n <= buckets:
        return list(sizes)
    s, c = np.array(sizes, dtype=np.float64), np.array(counts, dtype=np.float64)
    number, filled = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * s)])
    # padding of the bucket of sizes i..j, all padded to size j
    cost = lambda i, j: (number[j + 1] - number[i]) * s[j] - (filled[j + 1] - filled[i])
    best = np.array([cost(0, j) for j in range(n)])
    back = []
    for _ in range(1, buckets):
        now, at = best.copy(), np.zeros(n, dtype=np.int64)
        for j in range(1, n):
            i = np.arange(1, j + 1)
            total = best[i - 1] + cost(i, j)
            k = int(total.argmin())
            if total[k] < now[j]:
                now[j], at[j] = total[k], k + 1
        back.append(at)
        best = now
    bounds, j = [], n - 1
    for at in reversed(back):
        bounds.append(sizes[j])
        if at[j] == 0:
            return bounds[::-1]
        j = int(at[j]) - 1
    return [sizes[j], *bounds[::-1]]


def patterns(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``(containers, {bucket: items in each})``: batches of the largest bucket left, topped up with smaller ones."""
    left, out = list(counts), []
    while any(left):
        room, pattern = capacity, {}
        for b in range(len(bounds) - 1, -1, -1):
            if left[b] and bounds[b] <= room:
                take = min(left[b], room // bounds[b])
                pattern[b], room = take, room - take * bounds[b]
        times = min(left[b] // take for b, take in pattern.items())
        for b, take in pattern.items():
            left[b] -= take * times
        out.append((times, pattern))
    return out


def item_sizes(df: DataFrame, id_col: str, text_col: str, size: Callable[[Column], Column] = token_count) -> DataFrame:
    """``(id, tokens)``, written once so that the texts are read and counted once."""
    return cut_lineage(df.select(id_col, size(F.col(text_col)).alias("tokens")))


def size_classes(sizes: list[int], counts: list[int], most: int) -> tuple[list[int], list[int]]:
    """At most ``most`` of the ascending sizes with the counts of those up to each; all of them where there are no more.

    Sizes are merged into the next larger one that is kept, every so many of them, so a bound lies at most a class of sizes
    above where it would be best. Boundaries found on the classes are found in ``most`` squared steps whatever the capacity.
    """
    if len(sizes) <= most:
        return sizes, counts
    last = np.unique(np.ceil(np.linspace(0, len(sizes), most + 1)[1:]).astype(int)) - 1
    upto = np.cumsum(counts)[last]
    return [sizes[i] for i in last], np.diff(upto, prepend=0).tolist()


def pack_items(sizes: DataFrame, id_col: str, capacity: int, buckets: int = 64, rows_per_salt: int = 50_000, most_sizes: int = 2_048) -> DataFrame:
    """``(id, piece, pieces, tokens, bucket, container)`` for items ``(id, tokens)``."""
    whole = F.expr(f"cast(ceil(tokens / {capacity}) as int)")
    parts = sizes.withColumn("pieces", F.greatest(F.lit(1), whole)).withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)")))
    parts = parts.withColumn("tokens", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("int"))
    histogram = {r.tokens: r.n for r in parts.where("tokens > 0").groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    ordered = sorted(histogram)
    bounds = bucket_bounds(*size_classes(ordered, [histogram[x] for x in ordered], most_sizes), buckets) if ordered else []
    counts = [0] * len(bounds)
    for x in ordered:
        counts[bisect.bisect_left(bounds, x)] += histogram[x]
    plan, first = [], 0  # (bucket, first rank, items in each container, first container)
    used = [0] * len(bounds)
    for times, pattern in patterns(bounds, counts, capacity):
        for b, take in pattern.items():
            plan.append((b, used[b], take, first))
            used[b] += take * times
        first += times
    spark = sizes.sparkSession
    salts = max(1, -(-sum(counts) // rows_per_salt))
    bucket_of = F.lit(None).cast("int") if not bounds else F.expr(f"array_position(transform(array({','.join(map(str, bounds))}), b -> b >= tokens), true) - 1").cast("int")
    parts = parts.withColumn("bucket", F.when(F.col("tokens") > 0, bucket_of)).withColumn("salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)).cast("int"))
    # ranks: a running number inside (bucket, salt), on top of the counts of the salts before
    per = parts.where(F.col("bucket").isNotNull()).groupBy("bucket", "salt").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("bucket", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket", "salt").orderBy(F.xxhash64(id_col, "piece"), id_col, "piece")
    ranked = parts.join(base, ["bucket", "salt"], "left").withColumn("rank", F.col("base") + F.row_number().over(inside) - 1)
    rows = spark.createDataFrame([(b, [(r, t, c) for x, r, t, c in plan if x == b]) for b in range(len(bounds))], "bucket int, plan array<struct<rank: long, take: int, container: long>>")
    # the plan has one row per bucket, at most ``buckets``
    placed = ranked.join(F.broadcast(rows), "bucket", "left").withColumn("p", F.expr("element_at(filter(plan, x -> x.rank <= rank), -1)"))
    container = F.when(F.col("bucket").isNotNull(), F.col("p.container") + F.floor((F.col("rank") - F.col("p.rank")) / F.col("p.take")))
    return placed.select(id_col, "piece", "pieces", "tokens", "bucket", container.cast("long").alias("container"))
