"""Order over many tasks: running sums, ranks and quantiles of groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

#: Keys that hold at least this share of the rows are few enough to be sent to all tasks: there are no more than its inverse.
HEAVY = 4096
#: Buckets into which a round of quantile search cuts what may still hold the wanted value, and rows that are settled at once.
BUCKETS, SETTLED = 1024, 10_000
#: Groups of at most so many rows, or of a ten-thousandth of all, are settled in a task each.
SMALL, LARGE_GROUPS = 100_000, 10_000


def _same(left: str, right: str, keys: list[str]) -> Column:
    """Equality of the keys, nulls being equal."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return out


def prefix_sums(df: DataFrame, by: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of its group that come before it in ``order``.

    Rows are dealt by ranges of group and order and written, which settles where the ranges end. A window sums within a
    range; what a group holds in earlier ranges is summed over ranges. No task gets more than a range, also where one group
    holds all rows. Rows that are equal in ``order`` come one after another, in any order. ``df`` must not have the columns
    range_no, range_own and range_value.
    """
    keys = [F.col(f"`{b}`") for b in by]
    placed = written(df.withColumn("range_value", value).repartitionByRange(*keys, *order).withColumn("range_no", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("range_no", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("range_own", F.coalesce(F.sum("range_value").over(within), F.lit(0)))
    sums = placed.groupBy("range_no", *keys).agg(F.sum("range_value").alias("range_total"))
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("range_before", F.coalesce(F.sum("range_total").over(before), F.lit(0)))
    met = own.alias("o").join(sums.alias("s"), (F.col("o.range_no") == F.col("s.range_no")) & _same("o", "s", by))
    return met.select(*[F.col(f"o.`{c}`") for c in df.columns], (F.col("range_own") + F.col("range_before")).alias(out))


def positions(df: DataFrame, by: list[str], order: list[Column], out: str = "position") -> DataFrame:
    """``df`` with its rows numbered from 1 in each group, in ``order``."""
    return prefix_sums(df, by, order, F.lit(1).cast("bigint"), out).withColumn(out, F.col(out) + 1)


def join_counted(df: DataFrame, found: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``df`` joined with ``found``, which has one row a key and the number of rows that ``df`` has of it, in ``count``.

    Keys with at least a ``HEAVY``-th of all rows are at most ``HEAVY`` many: they go to all tasks, so their rows stay where
    they are. The rest is shuffled, no key of which is large. Null keys meet null keys.
    """
    total = found.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) * F.lit(HEAVY) >= F.lit(total)
    columns = [c for c in found.columns if c not in keys]
    joined = lambda rows, side: rows.alias("l").join(side.alias("r"), _same("l", "r", keys)).select("l.*", *[F.col(f"r.`{c}`") for c in columns])
    top = F.broadcast(found.where(heavy))
    rest = df.alias("l").join(top.alias("r"), _same("l", "r", keys), "left_anti")
    return joined(df, top).unionByName(joined(rest, found.where(~heavy)))


def average_rank(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """``df`` with ranks from 1 by ``value`` within each group, ties sharing their mean.

    A rank follows from how many rows have a smaller value, so only distinct values are put in order; a value that holds
    most rows is a single row there. ``df`` is read twice: write it first where it is dear.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("tied"))
    below = prefix_sums(counts, by, [F.col(f"`{value}`")], F.col("tied"), "below")
    ranks = below.select(*by, value, "tied", (F.col("below") + (F.col("tied") + 1) / F.lit(2.0)).alias(out))
    return join_counted(df, ranks, [*by, value], "tied").drop("tied")


def quantiles(df: DataFrame, by: list[str], value: Column, probabilities: list[float]) -> DataFrame:
    """(by.., probability, quantile): exact quantiles with linear interpolation, for groups of any size.

    Nulls don't count; a group without values has no row. What may hold a wanted rank is cut into buckets, of which only
    counts and bounds leave the tasks, and the bucket with the rank is cut again until it holds one value or few rows, of
    which the right one is then picked. Buckets are even on the values' own scale and on a logarithmic one by turns, so
    values of very different size don't share one for long. Groups of at most ``SMALL`` rows are settled in a task each.
    ``by`` must not use the names v, n, rank, low, high, below, p.
    """
    slim = df.select(*by, value.cast("double").alias("v")).where("v IS NOT NULL")
    ps = F.array(*[F.lit(float(p)) for p in probabilities])
    settle = lambda rows: rows.groupBy(*by).agg(F.percentile("v", ps).alias("qs")).select(*by, F.posexplode("qs").alias("p", "quantile")).select(*by, ps[F.col("p")].alias("probability"), "quantile")
    sizes = slim.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    seen = sizes.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    cut = max(SMALL, (seen["total"] or 0) // LARGE_GROUPS)
    if (seen["most"] or 0) <= cut:
        return settle(slim)
    slim, sizes = written(slim, "quantile-values"), written(sizes, "quantile-sizes")
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")
    at = F.col("p") * (F.col("n") - 1)
    both = sizes.where(F.col("n") > cut).select("*", wanted).select("*", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank"))
    targets = written(both.select(*by, "rank", "low", "high", F.lit(0).cast("bigint").alias("below"), "n").distinct(), "quantile-targets")
    meet = lambda t: slim.alias("s").join(F.broadcast(t).alias("t"), _same("s", "t", by) & F.col("s.v").between(F.col("t.low"), F.col("t.high")))
    keys = [*by, "rank"]
    done, turn = [], 0
    while True:
        settled = (F.col("n") <= SETTLED) | (F.col("low") == F.col("high"))
        done.append(targets.where(settled))
        open_ = targets.where(~settled)
        if open_.isEmpty():
            break
        scale = (lambda x: F.signum(x) * F.log1p(F.abs(x) / F.greatest(F.least(F.abs("t.low"), F.abs("t.high")), F.lit(1e-300)))) if turn % 2 else (lambda x: x)
        # halves keep the width of the widest bracket finite
        share = (scale(F.col("s.v")) / 2 - scale(F.col("t.low")) / 2) / (scale(F.col("t.high")) / 2 - scale(F.col("t.low")) / 2)
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
        cells = meet(open_).select(*[F.col(f"t.`{k}`") for k in keys], F.col("t.below").alias("below"), bucket.alias("bucket"), F.col("s.v").alias("v"))
        cells = cells.groupBy(*keys, "below", "bucket").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
        targets = written(cells.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n"))).select(*keys, "low", "high", "below", "n"), "quantile-targets")
        turn += 1
    ready = done[0]
    for more in done[1:]:
        ready = ready.unionByName(more)
    one = F.col("low") == F.col("high")
    picked = meet(ready.where(~one)).groupBy(*[F.col(f"t.`{k}`") for k in keys]).agg(F.sort_array(F.collect_list("s.v")).alias("vs"), F.first("t.below").alias("below"))
    order = ready.where(one).select(*keys, F.col("low").alias("at")).unionByName(picked.select(*keys, F.expr("vs[cast(rank - below as int)]").alias("at")))
    order = written(order, "order-statistics")
    asked = sizes.where(F.col("n") > cut).select(*by, "n", wanted)
    low, high = order.alias("l"), order.alias("h")
    found = asked.alias("a").join(low, _same("a", "l", by) & (F.col("l.rank") == F.floor(at))).join(high, _same("a", "h", by) & (F.col("h.rank") == F.ceil(at)))
    large = found.select(*[F.col(f"a.`{b}`") for b in by], F.col("p").alias("probability"), (F.col("l.at") + (at - F.floor(at)) * (F.col("h.at") - F.col("l.at"))).alias("quantile"))
    few = slim.alias("s").join(sizes.where(F.col("n") <= cut).alias("t"), _same("s", "t", by), "left_semi")
    return large.unionByName(settle(few.select("s.*")))
