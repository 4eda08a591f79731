"""Percentiles per group by distributed multi-select, and how to put them together.

Every round, the parts of the table propose the local median of each open range, the
weighted median of the proposals becomes the range's pivot, values are counted below, at
and above it, ranges that hold no wanted rank are discarded, and the rest go on until every
rank is found. A range of a few values is read off in order. The result is exact for each
group; grids of ranks from several days or partitions combine with a bounded error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utterlake.session import drop_path, store

#: A range of at most so many different values is read off in order instead of split again.
FEW = 1024


def _proposals(values: DataFrame) -> DataFrame:
    """(grp, part, median, n): the lower median of each range in each batch of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, p, v, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(g):
                continue
            order = np.lexsort((v, p, g))
            g, p, v, n = g[order], p[order], v[order], n[order]
            begin = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (p[1:] != p[:-1])))
            total = np.add.reduceat(n, begin)
            upto = np.cumsum(n)
            # the first value at which half of the range's are passed
            at = np.searchsorted(upto, upto[begin] - n[begin] + (total + 1) // 2)
            yield pa.RecordBatch.from_arrays([pa.array(g[begin]), pa.array(p[begin]), pa.array(v[at]), pa.array(total)], ["grp", "part", "median", "n"])

    return values.select("grp", "part", "value", "n").mapInArrow(run, "grp bigint, part int, median double, n bigint")


def select_ranks(values: DataFrame, targets: DataFrame) -> DataFrame:
    """(grp, wanted, value): the ``wanted``-th smallest value (from 1) of each group.

    ``values``: grp bigint, value double, n bigint (how often the value comes), one row per
    value, without nulls and NaN; infinities are values. ``targets``: grp bigint, wanted
    bigint; a rank must lie within the group's count, others have no row. Ties share their
    value. Of a range with most of the values only its medians, counts, and at last at most
    FEW values come together in one task. The open ranges of a group are numbered anew in
    each round; there are no more of them than ranks wanted from it.
    """
    spark = values.sparkSession
    range_ = ["grp", "part"]
    first, path = store(values.select("grp", F.lit(0).alias("part"), "value", "n"), "values", keep=False)
    # the last table of values, and the small ones
    held, paths = path, []
    sizes = first.groupBy(*range_).agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("different"))
    # wanted: the rank in the group; rank: in the range
    open_ = targets.distinct().select("grp", "wanted", F.lit(0).alias("part"), F.col("wanted").alias("rank")).join(sizes, range_).where("rank between 1 and size")
    open_, path = store(open_.drop("size"), "targets", keep=False)
    paths.append(path)
    values, done, left = first, [], None
    while True:
        few = F.col("different") <= FEW
        order = Window.partitionBy(*range_).orderBy("value")
        lists = values.join(open_.where(few).select(*range_).distinct(), range_, "left_semi").withColumn("upto", F.sum("n").over(order))
        told = lists.join(open_.where(few).select("grp", "part", "wanted", "rank"), range_).where("rank <= upto and rank > upto - n").select("grp", "wanted", "value")
        told, path = store(told, "found", keep=False)
        done.append(told)
        paths.append(path)
        going = open_.where(~few)
        now = going.select(*range_, "different").distinct().agg(F.sum("different")).first()[0]
        if now is None:
            break
        if left is not None and now >= left:
            raise RuntimeError("a round of the multi-select has discarded nothing")
        left = now
        values = values.join(going.select(*range_).distinct(), range_, "left_semi")
        # the weighted median of the proposals: the first at which half of the values are passed
        proposed = _proposals(values).groupBy(*range_, "median").agg(F.sum("n").alias("n"))
        proposed = proposed.withColumn("upto", F.sum("n").over(Window.partitionBy(*range_).orderBy("median"))).withColumn("total", F.sum("n").over(Window.partitionBy(*range_)))
        pivots, path = store(proposed.where("2 * upto >= total").groupBy(*range_).agg(F.min("median").alias("pivot")), "pivots", keep=False)
        paths.append(path)
        side = F.when(F.col("value") < F.col("pivot"), -1).when(F.col("value") > F.col("pivot"), 1).otherwise(0)
        sided, path = store(values.join(pivots, range_).select(*range_, side.alias("side"), "value", "n"), "sided", keep=False)
        drop_path(spark, held)
        held = path
        count = lambda s, c: F.coalesce(F.sum(F.when(F.col("side") == s, c)), F.lit(0))
        wide = sided.groupBy(*range_).agg(count(-1, F.col("n")).alias("below"), count(0, F.col("n")).alias("at"), count(-1, F.lit(1)).alias("lower"), count(1, F.lit(1)).alias("upper"))
        ranked = going.join(wide.join(pivots, range_), range_).drop("different")
        ranked = ranked.withColumn("side", F.when(F.col("rank") <= F.col("below"), -1).when(F.col("rank") > F.col("below") + F.col("at"), 1).otherwise(0))
        ranked = ranked.withColumn("new", (F.dense_rank().over(Window.partitionBy("grp").orderBy("part", "side")) - 1).cast("int"))
        ranked, path = store(ranked, "ranked", keep=False)
        paths.append(path)
        done.append(ranked.where("side = 0").select("grp", "wanted", F.col("pivot").alias("value")))
        on = ranked.where("side <> 0")
        values = sided.join(on.select("grp", "part", "side", "new").distinct(), ["grp", "part", "side"]).select("grp", F.col("new").alias("part"), "value", "n")
        open_ = on.select("grp", "wanted", F.col("new").alias("part"), F.when(F.col("side") < 0, F.col("rank")).otherwise(F.col("rank") - F.col("below") - F.col("at")).alias("rank"), F.when(F.col("side") < 0, F.col("lower")).otherwise(F.col("upper")).alias("different"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out, _ = store(out, "percentiles")
    for p in [held, *paths]:
        drop_path(spark, p)
    return out


def grids(df: DataFrame, by: list[str], value: str, steps: int = 100) -> DataFrame:
    """(by.., n, step, value): of each group, the values at the ranks ceil(step / steps * n),
    step = 0 (the least) to ``steps`` (the greatest): exact percentiles, and the form that
    :func:`combine` puts together.

    Null and NaN values are left out, infinities are values; a group without values has no
    row; null keys make a group of their own.
    """
    if not by:
        raise ValueError("grids needs a grouping column; use a constant for one group")
    v = F.col(value).cast("double")
    # equal values once, with their number
    counted, counted_path = store(df.where(v.isNotNull() & ~F.isnan(v)).select(*by, (v + F.lit(0.0)).alias("_v")).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")), "counted", keep=False)
    # a group's number is fixed once the table is written
    groups, path = store(counted.groupBy(*by).agg(F.sum("_n").alias("n")).withColumn("grp", F.monotonically_increasing_id()), "groups")
    match = counted.alias("a").join(groups.alias("g"), [F.col(f"a.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by])
    values = match.select("g.grp", F.col("a._v").alias("value"), F.col("a._n").alias("n"))
    step = F.explode(F.sequence(F.lit(0), F.lit(steps)))
    ranks = groups.select("*", step.alias("step")).withColumn("wanted", F.greatest(F.lit(1), F.ceil(F.col("step") * F.col("n") / F.lit(steps))).cast("bigint"))
    found = select_ranks(values, ranks.select("grp", "wanted"))
    drop_path(df.sparkSession, counted_path)
    return ranks.join(found, ["grp", "wanted"]).select(*by, "n", "step", "value")


def combine(parts: DataFrame, by: list[str], percents: list[int], part_cols: list[str]) -> DataFrame:
    """(by.., n, percent, value) from grids of parts that together make the groups ``by``.

    ``parts``: by.., part_cols.., n, step, value as :func:`grids` gives them, each part with its
    own n. A grid of s steps says that at least step / s of its values are at or below a
    point, and fewer than (step + 1) / s of them below the next: so the rank of the value
    found is off by at most N / s in all (plus one per part), however many parts there are.
    """
    keys = [*by, *part_cols]
    top = parts.groupBy(*keys).agg(F.max("step").alias("_s"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"t.{c}")) for c in keys]
    p = parts.alias("p").join(top.alias("t"), same).select(*[F.col(f"p.{c}").alias(c) for c in keys], "p.n", "p.step", "p.value", "t._s")
    # each point but the least stands for the values between its rank and the one before
    weight = F.ceil(F.col("step") * F.col("n") / F.col("_s")) - F.ceil((F.col("step") - 1) * F.col("n") / F.col("_s"))
    pts = p.where("step > 0").select(*by, "value", weight.alias("w")).groupBy(*by, "value").agg(F.sum("w").alias("w"))
    run = Window.partitionBy(*by).orderBy("value")
    acc = pts.withColumn("upto", F.sum("w").over(run)).withColumn("n", F.sum("w").over(Window.partitionBy(*by)))
    want = acc.select(*by, "value", "w", "upto", "n", F.explode(F.array(*[F.lit(x) for x in percents])).alias("percent"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("percent") * F.col("n") / F.lit(100)))
    return want.where((F.col("upto") >= rank) & (F.col("upto") - F.col("w") < rank)).select(*by, "n", "percent", "value")
